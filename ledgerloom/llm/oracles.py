"""DuckDB SQL for the queries that SQL can express; everything is worked out directly, without the operators' shortcuts."""

from __future__ import annotations

from ledgerloom.llm import decontaminate, hilbert, secrets


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def secret_scan() -> str:
    """Places by running sums over the texts between matches; entropies by counting every window's characters anew."""

    def matches(name: str, table: str, pattern: str) -> str:
        # One row a match and one for the rest of the text, in order; start counts code points.
        return f"""{name}_lists AS (SELECT rid, regexp_extract_all(t, {_text(pattern)}) AS f, string_split_regex(t, {_text(pattern)}) AS b FROM {table}),
{name}_rows AS (SELECT rid, unnest(generate_series(1, len(b))) AS i, f, b FROM {name}_lists),
{name} AS (SELECT rid, i, b[i] AS before, f[i] AS m, CAST(sum(length(b[i]) + coalesce(length(f[i - 1]), 0)) OVER (PARTITION BY rid ORDER BY i) AS BIGINT) AS start FROM {name}_rows)"""

    classes = ", ".join(f"({k}, {_text(c.kind)}, {_text(c.alphabet)}, {c.window}, {c.least_bits}, {c.kind == 'entropy_hex'})" for k, c in enumerate(secrets.CLASSES))
    java = lambda p: p.replace("++", "+").replace("*+", "*")  # noqa: E731  possessive marks only spare time
    allowed = " OR ".join(f"regexp_matches(s, {_text(java(p))})" for p in (secrets.KEY, *secrets.ALLOW))
    harmless = f"(regexp_matches(s, {_text(secrets.HARMLESS)}) AND NOT regexp_matches(regexp_replace(s, {_text(secrets.HARMLESS)}, ' ', 'g'), '[^ ]{{{secrets.LEAST}}}'))"
    return f"""WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
{matches("assign", "docs", secrets.ASSIGN)},
{matches("access", "docs", secrets.ACCESS)},
{matches("hexes", "docs", secrets.HEX)},
passed AS (SELECT *, coalesce(length(regexp_extract(m, {_text(secrets.ASSIGN)}, 2)) >= 6, false) AS ok FROM assign),
masked AS (SELECT rid, string_agg(before || CASE WHEN m IS NULL THEN '' WHEN ok THEN repeat(' ', length(m)) ELSE m END, '' ORDER BY i) AS t FROM passed GROUP BY rid),
{matches("candidate", "masked", secrets.CANDIDATE)},
strings AS (SELECT DISTINCT m AS s FROM candidate WHERE regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')),
judged AS (SELECT s FROM strings WHERE NOT ({allowed} OR {harmless})),
classes(rank, kind, alphabet, w, least, folded) AS (VALUES {classes}),
windows AS (SELECT s, rank, kind, alphabet, w, least, unnest(generate_series(1, length(s) - w + 1)) AS pos, CASE WHEN folded THEN upper(s) ELSE s END AS folded_s FROM judged, classes WHERE length(s) >= w),
characters AS (SELECT s, rank, kind, w, least, pos, alphabet, unnest(regexp_extract_all(substr(folded_s, pos, w), '.')) AS c FROM windows),
counted AS (SELECT s, rank, kind, w, least, pos, c, count(*) AS n FROM characters WHERE contains(alphabet, c) GROUP BY ALL),
entropies AS (SELECT s, rank, kind, w, least, pos, sum(n) AS m, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS bits FROM counted GROUP BY ALL),
verdicts AS (SELECT s, arg_min(kind, rank) AS kind FROM entropies WHERE m >= ceil(0.9 * w) AND round(bits, 9) >= least GROUP BY s),
spans AS (
  SELECT rid, start, 0 AS k, start + length(m) AS stop, 'assign' AS kind FROM passed WHERE ok
  UNION ALL SELECT rid, start, 1, start + length(m), 'access' FROM access WHERE length(m) >= 20
  UNION ALL SELECT rid, start, 2, start + length(m), 'hex' FROM hexes WHERE m IS NOT NULL
  UNION ALL SELECT rid, start, CASE WHEN kind = 'entropy_hex' THEN 3 ELSE 4 END, start + length(m), kind FROM candidate JOIN verdicts ON m = s),
joined AS (SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) FILTER (k < 3) AS base,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) AS spans FROM spans GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN joined USING (rid)"""


def hilbert_shards(bits: int = 4) -> str:
    """Ranks by one sort of the whole table; bins by running counts, the curve's steps and crc32 written out in SQL."""
    dims = ("source", "lang", "size_class")
    bins = ",\n".join(f"bin{i} AS (SELECT {d}, CAST((coalesce(sum(count(*)) OVER (ORDER BY {d} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * {1 << bits}) // (SELECT count(*) FROM docs) AS BIGINT) AS x{i} FROM docs GROUP BY {d})" for i, d in enumerate(dims))
    joins = " ".join(f"JOIN bin{i} ON docs.{d} IS NOT DISTINCT FROM bin{i}.{d}" for i, d in enumerate(dims))
    steps, last = [], "c0"

    def step(**new: str) -> None:
        nonlocal last
        cols = ", ".join(f"{new.get(f'x{i}', f'x{i}')} AS x{i}" for i in range(3))
        steps.append(f"c{len(steps) + 1} AS (SELECT rid, {cols}, {new.get('flip', 'flip')} AS flip FROM {last})")
        last = f"c{len(steps)}"

    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(3):
            swap = f"(xor(x0, x{i}) & {p})"
            new = {"x0": f"CASE WHEN x{i} & {q} <> 0 THEN xor(x0, {p}) ELSE xor(x0, {swap}) END"}
            if i:
                new[f"x{i}"] = f"CASE WHEN x{i} & {q} <> 0 THEN x{i} ELSE xor(x{i}, {swap}) END"
            step(**new)
        q >>= 1
    for i in range(1, 3):
        step(**{f"x{i}": f"xor(x{i}, x{i - 1})"})
    q = 1 << (bits - 1)
    while q > 1:
        step(flip=f"CASE WHEN x2 & {q} <> 0 THEN xor(flip, {q - 1}) ELSE flip END")
        q >>= 1
    place = " + ".join(f"(((xor(x{i}, flip) >> {b}) & 1) << {3 * b + 2 - i})" for b in range(bits) for i in range(3))
    curve = ",\n".join(steps)
    rule = "list_reduce(list_prepend(n, list_transform(range(8), lambda k: CAST(0 AS BIGINT))), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)"
    return f"""WITH crc_table AS (SELECT list({rule} ORDER BY n) AS t FROM (SELECT unnest(range(256)) AS n)),
hexed AS (SELECT row_number() OVER () AS rid, doc_id, source, lang, octet_length(encode(coalesce(text, ''))) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
docs AS (SELECT rid, doc_id, source, lang, size, (length(bin(size)) * 8 + ((size << 3) >> (length(bin(size)) - 1)) - 8) AS size_class,
  xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, size), lambda i: CAST('0x' || substr(h, 2 * i - 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS text_crc32 FROM hexed, crc_table),
{bins},
c0 AS (SELECT rid, x0, x1, x2, CAST(0 AS BIGINT) AS flip FROM docs {joins}),
{curve},
placed AS (SELECT rid, {place} AS hilbert FROM {last}),
totals AS (SELECT count(*) AS n, greatest({hilbert.MIN_SALTS}, count(*) // {hilbert.ROWS_PER_SALT}) AS salts FROM docs),
ranked AS (SELECT docs.*, hilbert, n, row_number() OVER (ORDER BY hilbert, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || text_crc32), 1, 8) AS BIGINT) % salts, doc_id NULLS FIRST, text_crc32) - 1 AS r FROM docs JOIN placed USING (rid), totals)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'rows' AS law, CAST(r * {hilbert.SHARDS} // n AS INTEGER) AS shard, CAST(r - ((r * {hilbert.SHARDS} // n) * n + {hilbert.SHARDS - 1}) // {hilbert.SHARDS} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, hilbert
FROM ranked"""


def decontaminate_docs() -> str:
    """Every gram of a text that is as long as some window, joined with the windows."""
    words = lambda t: f"regexp_extract_all(translate(coalesce(text, ''), {_text(decontaminate.ascii_uppercase)}, {_text(decontaminate.ascii_lowercase)}), {_text(decontaminate.WORD)}) AS w FROM {t}"
    w = decontaminate.WINDOW
    return f"""WITH items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {words("benchmark")}),
cut AS (SELECT item, w, least(len(w), {w}) AS n, unnest(generate_series(1, greatest(1, len(w) - {w - 1}))) AS i FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM cut),
docs AS (SELECT row_number() OVER () AS rid, doc_id, {words("documents")}),
places AS (SELECT rid, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM docs, (SELECT DISTINCT n FROM windows)),
grams AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram FROM places),
met AS (SELECT rid, i, n, item FROM grams JOIN windows USING (n, gram)),
hits AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + n - 1)) AS pos FROM met) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, item FROM met) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (rid) LEFT JOIN named USING (rid)"""


def hard_negatives() -> str:
    """All scores of all anchors."""
    return """WITH taking AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, CAST(list_dot_product(a.x, r.x) AS BIGINT) AS score FROM taking a, taking r WHERE a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k FROM scored WHERE same) WHERE k <= 5),
fitting AS (SELECT p.*, id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS k
  FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM fitting WHERE k <= 3"""
