"""The 42 features of a pair. Their order is the contract of trained models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmesh.functions.kernels import dice, jaccard, kernel_table, length_ratio, levenshtein_similarity, overlap
from kinmesh.functions.text import tokens

# Fixed order of the features.
FEATURES = tuple(
    """n_fuzz n_token_sort n_token_set n_partial n_partial_sort n_jw n_lev n_damerau
    root_fuzz root_sort root_set root_jw root_exact first_match first_jw
    n_jaccard n_overlap n_dice compact_sub len_diff len_ratio w_diff
    has_a2 a_fuzz a_token_sort a_token_set a_partial a_jw a_lev a_jaccard a_overlap a_len_ratio
    num_overlap num_exact num_jaccard has_matching_num word_overlap word_jaccard
    name_addr_prod is_source2 b_rank score_margin""".split()
)

_SIDES = ("name", "address", "name_clean", "name_root", "name_first", "name_compact", "addr_clean", "addr_norm", "addr_tokens", "addr_nums", "addr_words", "country")


def pairs(cands: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """Candidates with both sides' normalised forms, prefixed q_ and t_; candidates without a target go."""
    q = queries.select(F.col("entity_id").alias("s1_id"), *[F.col(c).alias(f"q_{c}") for c in _SIDES])
    t = targets.select(F.col("entity_id").alias("cand_id"), *[F.col(c).alias(f"t_{c}") for c in _SIDES])
    return cands.join(q, "s1_id").join(t, "cand_id")


def _cleaned_twice(pair: DataFrame) -> DataFrame:
    """Target names as features see them, cleaned once more: a cleaned 'null' is no name. The rule score takes names cleaned once."""
    none = F.col("t_name_clean") == "null"
    return pair.withColumns({f"t_{c}": F.when(none, "").otherwise(F.col(f"t_{c}")) for c in ("name_root", "name_first", "name_compact", "name_clean")})


def set_features(pair: DataFrame) -> DataFrame:
    """Features that need no kernel, as built-in expressions."""
    pair = _cleaned_twice(pair)
    a, b = F.array_distinct(tokens(F.col("q_name_clean"))), F.array_distinct(tokens(F.col("t_name_clean")))
    qc, tc = F.col("q_name_compact"), F.col("t_name_compact")
    # An address that is 'null' once cleaned counts as none.
    empty = F.col("t_addr_clean").isin("", "null") | (F.length("t_addr_norm") < 3)
    has = F.when(empty, 0.0).otherwise(1.0)
    own = lambda c: F.when(has > 0, c).otherwise(0.0)
    qn, tn = F.col("q_addr_nums"), F.col("t_addr_nums")
    numbered = (F.size(qn) > 0) & (F.size(tn) > 0)
    qw, tw = F.array_distinct("q_addr_words"), F.array_distinct("t_addr_words")
    shared = F.size(F.array_intersect(qn, tn))
    found = {
        "root_exact": F.when((F.col("q_name_root") != "") & (F.col("q_name_root") == F.col("t_name_root")), 1.0).otherwise(0.0),
        "first_match": F.when((F.col("q_name_first") != "") & (F.col("q_name_first") == F.col("t_name_first")), 1.0).otherwise(0.0),
        "n_jaccard": jaccard(a, b),
        "n_overlap": overlap(a, b),
        "n_dice": dice(a, b),
        "compact_sub": F.when((qc != "") & (tc != "") & (qc.contains(tc) | tc.contains(qc)), 1.0).otherwise(0.0),
        "len_diff": F.abs(F.length("q_name_clean") - F.length("t_name_clean")).cast("double"),
        "len_ratio": length_ratio(F.col("q_name_clean"), F.col("t_name_clean")),
        "w_diff": F.abs(F.size(a) - F.size(b)).cast("double"),
        "has_a2": has,
        "a_jaccard": own(jaccard(F.col("q_addr_tokens"), F.col("t_addr_tokens"))),
        "a_overlap": own(overlap(F.col("q_addr_tokens"), F.col("t_addr_tokens"))),
        "a_len_ratio": own(length_ratio(F.col("q_addr_norm"), F.col("t_addr_norm"))),
        "num_overlap": own(F.when(numbered, shared / F.size(qn)).otherwise(0.5)),
        "num_exact": own(F.when(numbered & (F.size(F.array_except(qn, tn)) == 0) & (F.size(qn) == F.size(tn)), 1.0).otherwise(0.0)),
        "num_jaccard": own(F.when(numbered, jaccard(qn, tn)).otherwise(0.5)),
        "has_matching_num": own(F.when(numbered & (shared > 0), 1.0).otherwise(0.0)),
        "word_overlap": own(F.when(F.size(qw) > 0, F.size(F.array_intersect(qw, tw)) / F.size(qw)).otherwise(0.5)),
        "word_jaccard": own(jaccard(qw, tw)),
        "is_source2": F.when(F.col("cand_id").startswith("S2-"), 1.0).otherwise(0.0),
        "b_rank": F.col("rank").cast("double"),
        "score_margin": (F.col("top_score") - F.col("score")) / (F.col("top_score") + 1e-5),
    }
    return pair.select("*", *[c.cast("double").alias(n) for n, c in found.items()])


def pair_features(pair: DataFrame) -> DataFrame:
    """s1_id, cand_id and the 42 features. All kernels of a pair come from one Arrow function.

    Kernels cost far more than moving a pair, so pairs are dealt evenly first, by a number of partitions that is not
    lowered for being small in bytes.
    """
    pair = _cleaned_twice(pair.repartition(int(pair.sparkSession.conf.get("spark.sql.shuffle.partitions")), "s1_id", "cand_id"))
    strings = {
        "kn": ("name_clean", ("ratio", "token_sort", "token_set", "partial", "partial_sort", "jaro_winkler", "damerau")),
        "kr": ("name_root", ("ratio", "token_sort", "token_set", "jaro_winkler")),
        "kf": ("name_first", ("jaro_winkler",)),
        "ka": ("addr_norm", ("ratio", "token_sort", "token_set", "partial", "jaro_winkler")),
    }
    columns = [(F.col(f"q_{c}"), F.col(f"t_{c}"), names, alias) for alias, (c, names) in strings.items()]
    out = set_features(pair).withColumn("k", kernel_table(columns))
    out = out.select("*", *[F.struct(*[F.col(f"k.{alias}_{n}").alias(n) for n in names]).alias(alias) for _, _, names, alias in columns])
    own = lambda c: F.when(F.col("has_a2") > 0, F.col(c)).otherwise(0.0)
    kernels = {
        "n_fuzz": F.col("kn.ratio"), "n_token_sort": F.col("kn.token_sort"), "n_token_set": F.col("kn.token_set"), "n_partial": F.col("kn.partial"),
        "n_partial_sort": F.col("kn.partial_sort"), "n_jw": F.col("kn.jaro_winkler"), "n_lev": levenshtein_similarity(F.col("q_name_clean"), F.col("t_name_clean")), "n_damerau": F.col("kn.damerau"),
        "root_fuzz": F.col("kr.ratio"), "root_sort": F.col("kr.token_sort"), "root_set": F.col("kr.token_set"), "root_jw": F.col("kr.jaro_winkler"),
        "first_jw": F.when((F.col("q_name_first") != "") & (F.col("t_name_first") != ""), F.col("kf.jaro_winkler")).otherwise(0.0),
        "a_fuzz": own("ka.ratio"), "a_token_sort": own("ka.token_sort"), "a_token_set": own("ka.token_set"), "a_partial": own("ka.partial"),
        "a_jw": own("ka.jaro_winkler"), "a_lev": F.when(F.col("has_a2") > 0, levenshtein_similarity(F.col("q_addr_norm"), F.col("t_addr_norm"))).otherwise(0.0),
    }
    out = out.select("*", *[c.alias(n) for n, c in kernels.items()])
    product = F.when(F.col("has_a2") > 0, F.col("n_token_sort") * F.col("a_token_sort")).otherwise(F.col("n_token_sort") * 0.9)
    return out.withColumn("name_addr_prod", product).select("s1_id", "cand_id", *FEATURES)
