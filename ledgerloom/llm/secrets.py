"""Secret scans over whole texts, in DataFrame functions only.

Base findings come from three patterns; the method adds spans found by sliding a window over candidate strings: runs of
the characters that secrets are written in, long enough to be one, and holding digits beside letters. In each window the
Shannon entropy of a character class is kept by incremental counts: with ``g(c) = c log2 c`` the sum of ``g`` over the
class's counts changes by two terms when one character leaves and one enters. How often a character stands in the window
that it enters or leaves is counted once for all classes. A candidate whose highest window reaches its class's threshold
is a span unless the allow-list knows it.

Cost is linear: long candidates are judged in chunks that overlap by a window, places of matches are running sums taken in
two levels (an array that grows by one is copied each time, so it never grows past a block), and redaction cuts pieces from
blocks of the text instead of counting characters from its start.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.shared import documents

# Fixed patterns of the contract, in the order in which kinds are listed.
ASSIGN_HEAD = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]"""
ASSIGN = ASSIGN_HEAD + r"""\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
KEY = r"^AKIA[A-Z0-9]{16,}$|^[0-9a-f]{24,}$"  # candidates that are base spans as they stand
HEX = r"[0-9a-f]{24,}"  # runs end where the class ends, so this is every run of the class with 24 characters
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_lower", "entropy_base32", "entropy_upper", "entropy_base64")


@dataclass(frozen=True)
class EntropyClass:
    """A character class: the alphabet that is counted, the window in characters, and the least entropy in bits."""

    kind: str
    alphabet: str
    window: int
    least_bits: float


# least_bits is what 99 of 100 random windows of the alphabet reach (by simulation of 100,000 windows); long candidates
# have several windows and are missed less. Windows of 16 are the shortest in which random strings stand out from words.
CLASSES = (
    EntropyClass("entropy_hex", "0123456789ABCDEF", 20, 2.9),
    EntropyClass("entropy_hex", "0123456789ABCDEF", 16, 2.65),
    EntropyClass("entropy_lower", "abcdefghijklmnopqrstuvwxyz0123456789", 20, 3.4),
    EntropyClass("entropy_lower", "abcdefghijklmnopqrstuvwxyz0123456789", 16, 3.14),
    EntropyClass("entropy_base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 20, 3.34),
    EntropyClass("entropy_base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16, 3.07),
    EntropyClass("entropy_upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 20, 3.4),
    EntropyClass("entropy_upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16, 3.14),
    EntropyClass("entropy_base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 20, 3.64),
    EntropyClass("entropy_base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 16, 3.37),
)
LEAST = min(c.window for c in CLASSES)
CANDIDATE = r"[A-Za-z0-9+/_=-]{%d,}" % LEAST
# Known harmless shapes: UUIDs, dotted or dashed words, URLs' paths, a word and a number.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^(?:[A-Za-z]++[-_/])++[A-Za-z]*+[0-9]{0,4}$",  # possessive: the engine doesn't recurse on long ones
    r"^[A-Za-z]+[-_=]?[0-9]+$",
)


# Known harmless pieces, of published example keys and of counting or alphabet runs: a candidate is left alone if no LEAST characters stand between them.
HARMLESS = r"(?i)example|sample|dummy|placeholder|changeme|redacted|abcdefgh|ijklmnop|qrstuvwx|01234567|12345678|98765432|qwertyui"
#: Array elements that are added up one by one; characters of a candidate judged together; characters of a text that pieces are cut from.
BLOCK, CHUNK, PAGE = 256, 1024, 4096
_SPANS = "array<struct<start:int,kind_order:int,end:int,kind:string,found:string>>"


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that it may mention often and that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each of ``values`` (array<int>, none negative) what ``op`` makes of all before it, from 0."""

    def fold(a: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(a, start, lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    zero = F.lit(0)
    blocks = lambda v: F.transform(F.sequence(zero, F.greatest(F.size(v) - 1, zero), F.lit(BLOCK)), lambda at: F.slice(v, at + 1, F.lit(BLOCK)))
    total = lambda bs: F.transform(bs, lambda b: F.aggregate(b, zero, op))
    # Totals of blocks are running values themselves, one level up; their number is small.
    each = lambda bs: named(fold(total(bs), zero), lambda firsts: F.flatten(F.transform(bs, lambda b, k: fold(b, F.get(firsts, k)))))
    return named(values, lambda v: named(blocks(v), each))


def _matches(text: Column, pattern: str, use: Callable[[Column], Column]) -> Column:
    """``use`` of struct<found, between, starts>: all leftmost matches, what lies between them, and where each match begins."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between"))
    sizes = lambda x: F.transform(x["found"], lambda m, i: F.length(F.get(x["between"], i)) + F.length(m))
    starts = lambda x: named(running(sizes(x), lambda a, b: a + b), lambda before: F.transform(before, lambda at, i: at + F.length(F.get(x["between"], i))))
    return named(both, lambda x: named(F.struct(x["found"].alias("found"), x["between"].alias("between"), starts(x).alias("starts")), use))


def _spans(x: Column, kind: str, order: int) -> Column:
    one = lambda m, at: F.struct(at.alias("start"), F.lit(order).alias("kind_order"), (at + F.length(m)).alias("end"), F.lit(kind).alias("kind"), m.alias("found"))
    return F.transform(x["found"], lambda m, i: one(m, F.get(x["starts"], i)))


def spans_of(text: Column, pattern: str, kind: str, order: int) -> Column:
    """All leftmost non-overlapping matches as array<struct<start, kind_order, end, kind, found>>, in code points."""
    return _matches(text, pattern, lambda x: _spans(x, kind, order))


def _assigned(found: Column) -> Column:
    return F.length(F.regexp_extract(found, ASSIGN, 2)) >= 6


def _without_assigned(text: Column) -> Column:
    """``text`` with blanks in place of every base span of the kind assign, so that all other places stay."""
    blank = lambda m: F.when(_assigned(m), F.repeat(F.lit(" "), F.length(m))).otherwise(m)
    pieces = lambda x: F.concat(F.transform(x["found"], lambda m, i: F.concat(F.get(x["between"], i), blank(m))), F.slice(x["between"], -1, 1))
    return named(F.struct(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(0)).alias("found"), F.split(text, ASSIGN, -1).alias("between")), lambda x: F.array_join(pieces(x), ""))


def _chunks(s: Column) -> Column:
    """``s`` in parts of CHUNK characters, each behind the end of the one before, so that every window lies whole in one of them."""
    overlap = max(c.window for c in CLASSES) - 1
    cut = F.regexp_extract_all(s, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    return named(cut, lambda parts: F.transform(parts, lambda p, i: F.when(i > 0, F.concat(F.substring(F.get(parts, i - 1), -overlap, overlap), p)).otherwise(p)))


def _steps(codes: Column, window: int) -> Column:
    """For each character struct<code, enter, leave>: by how much the sum of ``g`` grows when it enters its window, and shrinks when it leaves."""
    g = [k * math.log2(k) if k else 0.0 for k in range(window + 1)]
    grown = F.lit([g[k + 1] - g[k] for k in range(window)])
    before = lambda c, i: F.size(F.filter(F.slice(codes, F.greatest(i - window + 2, F.lit(1)), F.least(i, F.lit(window - 1))), lambda x: x == c))
    after = lambda c, i: F.size(F.filter(F.slice(codes, i + 2, F.lit(window - 1)), lambda x: x == c))
    return F.transform(codes, lambda c, i: F.struct(c.alias("code"), F.get(grown, before(c, i)).alias("enter"), F.get(grown, after(c, i)).alias("leave")))


def _peak(steps: Column, c: EntropyClass) -> Column:
    """The highest entropy in bits of the class's characters in any window; 0 if none has nine tenths of its characters in the class."""
    w = c.window
    member = F.lit([chr(k) in c.alphabet for k in range(128)])
    state = F.struct(F.lit(0.0).alias("g"), F.lit(0).alias("m"), F.lit(0.0).alias("peak"))

    def step(acc: Column, i: Column) -> Column:
        come, gone = F.get(steps, i), F.get(steps, i - w)  # before the first window is full, nobody leaves
        comes, goes = F.get(member, come["code"]), (i >= w) & F.coalesce(F.get(member, gone["code"]), F.lit(False))
        g = acc["g"] + F.when(comes, come["enter"]).otherwise(0.0) - F.when(goes, gone["leave"]).otherwise(0.0)
        m = acc["m"] + comes.cast("int") - goes.cast("int")
        moved = F.struct(g.alias("g"), m.alias("m"), acc["peak"].alias("peak"))
        bits = lambda x: F.when((i >= w - 1) & (x["m"] >= math.ceil(0.9 * w)), F.log2(x["m"].cast("double")) - x["g"] / x["m"]).otherwise(0.0)
        return named(moved, lambda x: F.struct(x["g"].alias("g"), x["m"].alias("m"), F.greatest(x["peak"], bits(x)).alias("peak")))

    return F.aggregate(F.sequence(F.lit(0), F.size(steps) - 1), state, step, lambda acc: acc["peak"])


def _codes(s: Column) -> Column:
    return F.transform(F.split(s, ""), lambda c: F.ascii(c))


def peak_entropy(s: Column, c: EntropyClass) -> Column:
    """The highest entropy in bits of the class's characters in any window of ``s`` (ASCII, not empty)."""
    return F.array_max(F.transform(_chunks(s), lambda part: named(_codes(part), lambda codes: named(_steps(codes, c.window), lambda x: _peak(x, c)))))


def _rank(part: Column) -> Column:
    """The number of the first class in CLASSES that the chunk reaches, or how many there are."""
    none = len(CLASSES)

    def first(numbers: list[int], steps: dict[int, Column]) -> Column:
        out = F.lit(none)
        for k in reversed(numbers):
            c = CLASSES[k]
            out = F.when(F.round(_peak(steps[c.window], c), 9) >= c.least_bits, F.lit(k)).otherwise(out)
        return out

    def judged(s: Column, numbers: list[int], otherwise: Column | None = None) -> Column:
        windows = sorted({CLASSES[k].window for k in numbers})
        steps = lambda codes: F.struct(*[_steps(codes, w).alias(f"w{w}") for w in windows])
        return named(_codes(s), lambda codes: named(steps(codes), lambda x: first(numbers, {w: x[f"w{w}"] for w in windows})))

    folded = [k for k, c in enumerate(CLASSES) if c.kind == "entropy_hex"]
    plain = [k for k, c in enumerate(CLASSES) if c.kind != "entropy_hex"]
    return named(judged(F.upper(part), folded), lambda k: F.when(k < none, k).otherwise(judged(part, plain)))


def _suspect(s: Column) -> Column:
    """The added kind of a candidate, or null."""
    allowed = s.rlike(KEY) | (s.rlike(HARMLESS) & ~F.regexp_replace(s, HARMLESS, " ").rlike(f"[^ ]{{{LEAST}}}"))
    for pattern in ALLOW:
        allowed = allowed | s.rlike(pattern)
    mixed = s.rlike("[0-9]") & s.rlike("[A-Za-z]")
    kinds = F.lit([c.kind for c in CLASSES])
    return F.when(mixed & ~allowed, F.get(kinds, F.array_min(F.transform(_chunks(s), _rank))))


def find_secrets(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds base_spans and added_spans: array<struct<start, kind_order, end, kind, found>> each, ordered by start, then kind.

    Null and empty texts have none. An added span is a whole candidate; candidates end where a base span of the kind
    assign begins, and contain base spans of the other kinds if what lies beside those belongs to the same string. Rows
    repeat and other columns pass through as they are, but must not be called base_spans or added_spans.
    """
    clash = {"base_spans", "added_spans"} & set(df.columns)
    if clash:
        raise ValueError(f"columns already there: {sorted(clash)}")
    return df.withColumns(_found(F.coalesce(F.col(text), F.lit(""))))


def _found(t: Column) -> dict[str, Column]:
    none = F.array().cast(_SPANS)
    # Most texts have no match: one cheap search each decides whether places are worked out.
    guarded = lambda test, spans: F.when(test, spans).otherwise(none)
    assign = guarded(t.rlike(ASSIGN_HEAD), F.filter(spans_of(t, ASSIGN, "assign", 0), lambda x: _assigned(x["found"])))
    access = guarded(F.contains(t, F.lit("AKIA")), F.filter(spans_of(t, ACCESS, "access", 1), lambda x: F.length(x["found"]) >= 20))
    hexes = guarded(t.rlike("[0-9a-f]{24}"), spans_of(t, HEX, "hex", 2))
    rest = F.when(t.rlike(ASSIGN_HEAD), _without_assigned(t)).otherwise(t)
    judged = lambda spans: F.transform(spans, lambda x: F.struct(x["start"], x["end"], x["found"], _suspect(x["found"]).alias("kind")))
    kept = lambda spans: F.filter(judged(spans), lambda x: x["kind"].isNotNull())
    shaped = lambda x: F.struct(x["start"], F.when(x["kind"] == CLASSES[0].kind, 3).otherwise(4).alias("kind_order"), x["end"], x["kind"], x["found"])
    added = guarded(t.rlike(CANDIDATE), F.transform(kept(named(rest, lambda r: spans_of(r, CANDIDATE, "candidate", 3))), shaped))
    return {"base_spans": F.array_sort(F.concat(assign, access, hexes)), "added_spans": F.array_sort(added)}


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``df`` with every span of ``text`` replaced by ``mark``; where spans overlap, their union is replaced once.

    Texts without spans (null and empty ones too), all other columns whatever their names, and repeated rows stay as they are.
    """
    found = _found(F.coalesce(F.col(text), F.lit("")))
    # Only what is cut is carried; a piece costs the pages that it touches.
    cut = F.array_sort(F.transform(F.concat(found["base_spans"], found["added_spans"]), lambda x: F.struct(x["start"], x["end"])))
    pages = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{PAGE}}}"), F.lit(0))

    def piece(x: Column, a: Column, b: Column) -> Column:
        page = F.floor(a / PAGE).cast("int")
        joined = F.array_join(F.slice(x["pages"], page + 1, F.floor((b - 1) / PAGE).cast("int") - page + 1), "")
        return F.when(b > a, F.substring(joined, a % PAGE + 1, b - a)).otherwise("")

    def cleaned(x: Column) -> Column:
        kept = lambda s, i: F.concat(piece(x, F.get(x["reach"], i), s["start"]), F.when(s["start"] >= F.get(x["reach"], i), F.lit(mark)).otherwise(""))
        last = F.greatest(F.get(x["reach"], F.size(x["cut"]) - 1), F.array_max(F.transform(F.slice(x["cut"], -1, 1), lambda s: s["end"])))
        return F.concat(F.array_join(F.transform(x["cut"], kept), ""), piece(x, last, x["n"]))

    reach = lambda spans: running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    parts = lambda spans: F.struct(spans.alias("cut"), reach(spans).alias("reach"), pages.alias("pages"), F.length(F.col(text)).alias("n"))
    clean = named(cut, lambda spans: F.when(F.size(spans) > 0, named(parts(spans), cleaned)))
    return df.withColumn(text, F.coalesce(clean, F.col(text)))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base_spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_joined(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base_spans", "added_spans"))).alias("spans"),
    )
