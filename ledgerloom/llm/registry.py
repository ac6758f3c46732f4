"""The subpackage's queries and their SQL, for ``__spark_entry__.py``."""

from ledgerloom.llm import oracles
from ledgerloom.llm.decontaminate import op11_decontaminate
from ledgerloom.llm.fracsketch import op7_fracsketch
from ledgerloom.llm.gam import op5_quality_gam
from ledgerloom.llm.hardneg import op12_hard_negatives
from ledgerloom.llm.hilbert import op1_hilbert_shards
from ledgerloom.llm.mixing import op10_mix_sources
from ledgerloom.llm.ordinal import op6_toxicity_ordinal
from ledgerloom.llm.packing import op8_best_fit_packing
from ledgerloom.llm.pitmanyor import op4_pitman_yor
from ledgerloom.llm.rules import op9_quality_rules
from ledgerloom.llm.secrets import op3_secret_scan
from ledgerloom.llm.simhash import op2_simhash_dedup
from ledgerloom.llm.whitening import op13_whitening

QUERIES = {
    "op1_hilbert_shards": op1_hilbert_shards,
    "op2_simhash_dedup": op2_simhash_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_pitman_yor": op4_pitman_yor,
    "op5_quality_gam": op5_quality_gam,
    "op6_toxicity_ordinal": op6_toxicity_ordinal,
    "op7_fracsketch": op7_fracsketch,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_quality_rules": op9_quality_rules,
    "op10_mix_sources": op10_mix_sources,
    "op11_decontaminate": op11_decontaminate,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_whitening": op13_whitening,
}

#: The others can't be said in SQL: XXH64, sampling, fitted models, a tokenizer.
ORACLE_SQL: dict[str, str] = {
    "op1_hilbert_shards": oracles.hilbert_shards(),
    "op3_secret_scan": oracles.secret_scan(),
    "op11_decontaminate": oracles.decontaminate_docs(),
    "op12_hard_negatives": oracles.hard_negatives(),
}
