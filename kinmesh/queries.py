"""Registry of the record-linkage queries over the driver's tables, with the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmesh.cluster import materialise, shared_folder
from kinmesh.functions import kernels as K
from kinmesh.functions import text as T
from kinmesh.functions.vocabulary import ADDRESS_WORDS, LEGAL_SUFFIXES
from kinmesh.operators import blocking as B
from kinmesh.operators import features as X
from kinmesh.operators import matching as M
from kinmesh.operators import metrics as E
from kinmesh.operators import models as L
from kinmesh.operators import records as R
from kinmesh.operators import sampling as S
from kinmesh.plans import fixtures as D
from kinmesh.settings import Settings

#: The limits of a production run.
TOP, POSTINGS = Settings.k, Settings.max_postings
#: Low enough to matter on small data.
THRESHOLDS = {"en": 0.7, "fr": 0.6}
DEFAULT_THRESHOLD, MARGIN = 0.65, 0.05
N_TRAIN, SAMPLE = 150, 120
#: Entities that models are trained on, at most.
TRAINED = 35_000

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _norm(spark, sf_dir, **kw) -> DataFrame:
    return R.normalise(D.entities(spark, sf_dir), **kw)


def _written(spark, sf_dir) -> DataFrame:
    """Normalised records and their keys as a table: plans with candidates read them several times, and texts are scanned once."""
    return materialise(B.with_keys(_norm(spark, sf_dir)), "records")


def _cands(norm: DataFrame) -> DataFrame:
    return B.candidates(norm.filter(D.is_query()), norm.filter(~D.is_query()), TOP, POSTINGS)


def _joined(norm: DataFrame, cands: DataFrame) -> DataFrame:
    return X.pairs(cands, norm.filter(D.is_query()), norm.filter(~D.is_query()))


def _pairs(spark, sf_dir) -> DataFrame:
    norm = _written(spark, sf_dir)
    return _joined(norm, _cands(norm))


def _scored(norm: DataFrame, cands: DataFrame | None = None) -> DataFrame:
    """Candidates with a score of set similarities alone."""
    f = X.set_features(_joined(norm, _cands(norm) if cands is None else cands))
    return f.select("s1_id", "cand_id", "rank", F.col("q_country").alias("country"), F.round(0.6 * F.col("n_jaccard") + 0.4 * F.col("a_jaccard"), 9).alias("p"))


def _kept(norm: DataFrame, cands: DataFrame | None = None) -> DataFrame:
    return M.ensemble_gate(_scored(norm, cands), THRESHOLDS, DEFAULT_THRESHOLD, MARGIN)


_IS_Q, _IS_T = "entity_id like 'S1-%'", "entity_id not like 'S1-%'"
_NORM = f"{D.ENTITIES}, {R.sql_normalise('ent')}"
_KEYS = f"{_NORM}, {B.sql_keys()}"
_CAND = f"{_KEYS}, {B.sql_candidates(_IS_Q, _IS_T, TOP, POSTINGS)}"
_JACCARD = lambda a, b: f"case when len(list_distinct(list_concat({a}, {b}))) = 0 then 1.0 else len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) end"
_OVERLAP = lambda a, b: f"case when least(len({a}), len({b})) = 0 then 0.0 else len(list_intersect({a}, {b})) / least(len({a}), len({b})) end"
_SIDE = lambda p: ", ".join(f"{p}.{c} as {p}_{c}" for c in X._SIDES)
_PAIR = f"""{_CAND},
pr as (select s1_id, cand_id, score, rank, top_score, {_SIDE('q')}, {_SIDE('t')} from cand join norm q on s1_id = q.entity_id join norm t on cand_id = t.entity_id),
ps as (select *, list_distinct({T.sql_tokens('q_name_clean')}) as qa, list_distinct({T.sql_tokens('t_name_clean')}) as ta,
              list_distinct(q_addr_words) as qw, list_distinct(t_addr_words) as tw,
              case when t_addr_clean in ('', 'null') or length(t_addr_norm) < 3 then 0.0 else 1.0 end as has_a2,
              len(q_addr_nums) > 0 and len(t_addr_nums) > 0 as numbered, len(list_intersect(q_addr_nums, t_addr_nums)) as shared from pr),
fs as (select *, {_JACCARD('qa', 'ta')} as n_jaccard, has_a2 * {_JACCARD('q_addr_tokens', 't_addr_tokens')} as a_jaccard from ps)"""
_SCORED = f"{_PAIR}, scored as (select s1_id, cand_id, rank, q_country as country, round(0.6 * n_jaccard + 0.4 * a_jaccard, 9) as p from fs)"
_LIMIT = "case country " + " ".join(f"when '{k}' then {v}" for k, v in THRESHOLDS.items()) + f" else {DEFAULT_THRESHOLD} end"
_KEPT = f"{_SCORED}, kept as (select s1_id, cand_id, rank, country, p from (select *, max(p) over (partition by s1_id) as best, {_LIMIT} as lim from scored) where round(best, 9) >= round(lim + {MARGIN}, 9) and round(p, 9) >= round(lim, 9))"
_SCORES = """case when n_pred = 0 and n_true = 0 then 1.0 when tp = 0 then 0.0 else tp / n_pred end as precision,
             case when n_pred = 0 and n_true = 0 then 1.0 when tp = 0 then 0.0 else tp / n_true end as recall,
             case when n_pred = 0 and n_true = 0 then 1.0 when tp = 0 then 0.0 else 1.25 * (tp / n_pred) * (tp / n_true) / (0.25 * (tp / n_pred) + tp / n_true) end as f05"""
_F05 = f"""{_KEPT}, {D.TRUTH},
en as (select s1_id, country, len(matches) as n_true, coalesce(n, 0) as n_pred, coalesce(h, 0) as tp from truth
       left join (select s1_id, count(*) as n, count(*) filter (where list_contains(matches, cand_id)) as h from kept join truth using (s1_id) group by s1_id) using (s1_id)),
es as (select *, {_SCORES} from en)"""


def _sql(ctes: str, select: str) -> str:
    return f"with {ctes.strip()} {select}"


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _six_places(c: Column) -> Column:
    """A number of at least 0 rounded as SQL does, by its product with a million; Spark's rounding takes the shortest decimal form, which differs at some ties."""
    return F.floor(c * 1e6 + 0.5) / 1e6


# Sources


@query("union_targets", _sql(D.ENTITIES, "select entity_id, name, address, country from ent where entity_id not like 'S1-%'"))
def _(spark, d):
    from kinmesh.sources.files import union_targets

    e = D.entities(spark, d)
    return union_targets(e.filter(F.col("entity_id").startswith("S2-")), e.filter(F.col("entity_id").startswith("S3-")))


@query("country_filter", _sql(D.ENTITIES, "select entity_id, name, address, country from ent where country = 'fr'"))
def _(spark, d):
    return D.entities(spark, d).filter(F.col("country") == "fr")


@query("tsv_scan", _sql(D.ENTITIES, "select entity_id, coalesce(name, '') as name, coalesce(address, '') as address, country from ent where coalesce(country, '') <> ''"))
def _(spark, d):
    """The records written as tab-separated text to the shared folder and read again."""
    from kinmesh.sources.files import read_records, write_tsv

    path = f"{shared_folder(spark)}/records.tsv"
    write_tsv(D.entities(spark, d), path)
    return read_records(spark, path)


_RAW_TRUTH = "raw as (select s1_id, array_to_string(list_transform(matches, lambda x: ' ' || x || ' '), ',') || ', ,' as ids from truth)"


@query("gt_parse", _sql(f"{D.ENTITIES}, {D.TRUTH}", "select s1_id, array_to_string(matches, '|') as matches, cast(len(matches) as integer) as n from truth"))
def _(spark, d):
    t = D.truth(D.entities(spark, d))
    raw = t.select("s1_id", F.concat(F.array_join(F.transform("matches", lambda x: F.concat(F.lit(" "), x, F.lit(" "))), ","), F.lit(", ,")).alias("matched_entity_ids"))
    return E.parse_truth(raw).select("s1_id", F.array_join("matches", "|").alias("matches"), F.size("matches").alias("n"))


@query(
    "threshold_merge",
    """with given as (select lang as country, round(0.5 + (count(*) % 40) / 100, 2) as threshold from documents where lang is not null group by lang union all select 'India', round(0.5 + (count(*) % 40) / 100, 2) from documents)
    select country, threshold from given union all select * from (values ('US', 0.94::double), ('India', 0.94::double), ('France', 0.96::double)) v(country, threshold) where country not in (select country from given)""",
)
def _(spark, d):
    """Thresholds by language and one for India, written as JSON, read again and laid over the defaults."""
    from kinmesh.sources.files import read_thresholds, write_thresholds

    docs, some = D.table(spark, d, "documents"), F.round(0.5 + F.pmod(F.count("*"), F.lit(40)) / 100, 2).alias("threshold")
    given = {r["lang"]: r["threshold"] for r in docs.filter("lang is not null").groupBy("lang").agg(some).collect()} | {"India": docs.agg(some).first()[0]}  # a few entries
    path = f"{shared_folder(spark)}/thresholds"
    write_thresholds(spark, given, path)
    return spark.createDataFrame(list(M.merge_thresholds(read_thresholds(spark, path)).items()), "country string, threshold double")


# Text functions


@query("clean_text", f"select doc_id, {T.sql_clean('text')} as cleaned from documents")
def _(spark, d):
    return D.table(spark, d, "documents").select("doc_id", T.clean_text(F.col("text")).alias("cleaned"))


@query("clean_conversations", f"select conv_id, turn, {T.sql_clean('text')} as cleaned from conversations")
def _(spark, d):
    return D.table(spark, d, "conversations").select("conv_id", "turn", T.clean_text(F.col("text")).alias("cleaned"))


@query("translit", f"select doc_id, {T.sql_ascii('text')} as ascii_text from documents")
def _(spark, d):
    return D.table(spark, d, "documents").select("doc_id", T.to_ascii(F.col("text")).alias("ascii_text"))


@query("leet_fix", f"select c_custkey, {T.sql_leet('t')} as fixed from (select c_custkey, lower(replace(c_name, '#', 'o')) || ' br0wn be11o a0b0c x1y1z' as t from customer)")
def _(spark, d):
    t = F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("o"))), F.lit(" br0wn be11o a0b0c x1y1z"))
    return D.table(spark, d, "customer").select("c_custkey", T.leet_fix(t).alias("fixed"))


@query("num_norm", f"select c_custkey, {T.sql_number('t')} as number from (select c_custkey, lpad(cast(c_custkey % 100 as varchar), 6, '0') as t from customer)")
def _(spark, d):
    t = F.lpad(F.pmod("c_custkey", F.lit(100)).cast("string"), 6, "0")
    return D.table(spark, d, "customer").select("c_custkey", T.normalize_number(t).alias("number"))


_NAME_COLUMNS = ("entity_id", "name_clean", "name_root", "name_first", "name_compact")


@query("name_norm", _sql(_NORM, f"select {', '.join(_NAME_COLUMNS)} from norm"))
def _(spark, d):
    return _norm(spark, d).select(*_NAME_COLUMNS)


@query("name_norm_domain", _sql(f"{D.ENTITIES}, {R.sql_normalise('ent', True)}", f"select {', '.join(_NAME_COLUMNS)} from norm"))
def _(spark, d):
    return _norm(spark, d, strip_domain_words=True).select(*_NAME_COLUMNS)


_SUFFIXED = "p_name || ' ' || case p_partkey % 4 when 0 then 'Pvt Ltd' when 1 then 'S.A.' when 2 then 'Inc' else 'et fils' end"


@query("legal_suffix", f"select p_partkey, array_to_string({T.sql_root('c')}, ' ') as root from (select p_partkey, {T.sql_clean('n')} as c from (select p_partkey, {_SUFFIXED} as n from part))")
def _(spark, d):
    return D.table(spark, d, "part").select("p_partkey", T.clean_text(F.expr(_SUFFIXED)).alias("c")).select("p_partkey", F.array_join(T.root_tokens(F.col("c")), " ").alias("root"))


_ADDRESS_SQL = "entity_id, addr_clean, addr_norm, array_to_string(list_sort(addr_tokens), '|') as tokens, array_to_string(list_sort(addr_nums), '|') as numbers, array_to_string(addr_words, '|') as words"


def _address(norm: DataFrame) -> DataFrame:
    return norm.select("entity_id", "addr_clean", "addr_norm", F.array_join(F.array_sort("addr_tokens"), "|").alias("tokens"), F.array_join(F.array_sort("addr_nums"), "|").alias("numbers"), F.array_join("addr_words", "|").alias("words"))


@query("addr_norm", _sql(_NORM, f"select {_ADDRESS_SQL} from norm"))
def _(spark, d):
    return _address(_norm(spark, d))


@query("addr_norm_numbered", _sql(f"{D.NUMBERED}, {R.sql_normalise('ent')}", f"select {_ADDRESS_SQL} from norm"))
def _(spark, d):
    return _address(R.normalise(D.numbered(spark, d)))


_SHORT = list(ADDRESS_WORDS)


@query("addr_abbrev", f"select c_custkey, array_to_string({T.sql_runs('a')}, ' ') as written from (select c_custkey, c_custkey || ([{T.sql_list(_SHORT)}])[1 + c_custkey % {len(_SHORT)}] || ' x' as a from customer)")
def _(spark, d):
    a = F.concat("c_custkey", F.element_at(F.array(*map(F.lit, _SHORT)), (1 + F.pmod("c_custkey", F.lit(len(_SHORT)))).cast("int")), F.lit(" x"))
    return D.table(spark, d, "customer").select("c_custkey", F.array_join(T.address_runs(a), " ").alias("written"))


@query(
    "suffix_words",
    f"""select word, count(*) as n from (select unnest({T.sql_tokens('c')}) as word from (select {T.sql_clean('n')} as c from (select {_SUFFIXED} as n from part union all select text from conversations)))
    where word in ({T.sql_list(LEGAL_SUFFIXES)}) group by word""",
)
def _(spark, d):
    """How often each legal form is met in part names with legal forms and in conversations."""
    names = D.table(spark, d, "part").select(F.expr(_SUFFIXED).alias("n")).unionByName(D.table(spark, d, "conversations").select(F.col("text").alias("n")))
    words = names.select(F.explode(T.tokens(T.clean_text(F.col("n")))).alias("word"))
    return words.filter(F.col("word").isin(*LEGAL_SUFFIXES)).groupBy("word").agg(F.count("*").alias("n"))


# Blocking


@query("block_keys", _sql(_KEYS, "select entity_id, country, key, weight, mult from keys"))
def _(spark, d):
    return B.block_keys(_norm(spark, d))


@query("block_keys_numbered", _sql(f"{D.NUMBERED}, {R.sql_normalise('ent')}, {B.sql_keys()}", "select entity_id, country, key, weight, mult from keys"))
def _(spark, d):
    return B.block_keys(R.normalise(D.numbered(spark, d)))


@query("key_weights", _sql(_KEYS, "select split_part(key, '_', 1) as family, weight, count(*) as n from keys group by all"))
def _(spark, d):
    return B.block_keys(_norm(spark, d)).groupBy(F.split("key", "_")[0].alias("family"), "weight").agg(F.count("*").alias("n"))


@query("inverted_index", _sql(_CAND, "select country, key, cand_id, mult from idx"))
def _(spark, d):
    return B.inverted_index(_norm(spark, d).filter(~D.is_query()))


@query("posting_prune", _sql(_CAND, "select country, key, cand_id, mult from pruned"))
def _(spark, d):
    return B.prune(B.inverted_index(_norm(spark, d).filter(~D.is_query())), POSTINGS)


@query("candidate_votes", _sql(_CAND, "select s1_id, cand_id, score from votes"))
def _(spark, d):
    n = _written(spark, d)
    return B.votes_in_blocks(n.filter(D.is_query()), n.filter(~D.is_query()), POSTINGS)


@query("candidates_topk", _sql(_CAND, "select s1_id, cand_id, score, rank from cand"))
def _(spark, d):
    return _cands(_written(spark, d)).select("s1_id", "cand_id", "score", "rank")


@query("cand_rank_margin", _sql(_CAND, "select s1_id, cand_id, rank, top_score, round((top_score - score) / (top_score + 1e-5), 6) as margin from cand"))
def _(spark, d):
    return _cands(_written(spark, d)).select("s1_id", "cand_id", "rank", "top_score", F.round((F.col("top_score") - F.col("score")) / (F.col("top_score") + 1e-5), 6).alias("margin"))


@query("pair_join", _sql(_PAIR, "select s1_id, cand_id, q_name_clean, t_name_clean, q_addr_norm, t_addr_norm from pr"))
def _(spark, d):
    return _pairs(spark, d).select("s1_id", "cand_id", "q_name_clean", "t_name_clean", "q_addr_norm", "t_addr_norm")


@query("fan_out", _sql(_CAND, "select cast(coalesce(sum(q.n * t.n), 0) as bigint) as join_rows from (select country, key, count(*) as n from keys where entity_id like 'S1-%' group by all) q join (select country, key, count(*) as n from idx group by all) t using (country, key)"))
def _(spark, d):
    n = _norm(spark, d)
    return B.fan_out(n.filter(D.is_query()), B.inverted_index(n.filter(~D.is_query())))


# Similarities


_LIMB = 100
_FULL = lambda n: f"((1::hugeint << least({_LIMB}, greatest(0, cast({n} as integer)))) - 1)"


def _ratio_sql(pairs: str, name: str = "rt") -> str:
    """CTE ``name`` (a, b, r) for a relation of strings a and b, the shorter of at most 200 characters.

    The common subsequence as bit vectors in two integers of a hundred bits, one step for each character of the longer string.
    """
    lo, hi = f"s_lo & coalesce(m.lo, 0)", f"s_hi & coalesce(m.hi, 0)"
    return f"""{name}_p as materialized (select a, b, case when length(a) <= length(b) then a else b end as s, case when length(a) <= length(b) then b else a end as l from (select distinct a, b from {pairs})),
    {name}_k as (select s, unnest(range(1, length(s) + 1)) as k from (select distinct s from {name}_p)),
    {name}_m as materialized (select s, substr(s, cast(k as integer), 1) as c, cast(sum(case when k <= {_LIMB} then 1::hugeint << cast(k - 1 as integer) else 0::hugeint end) as hugeint) as lo,
               cast(sum(case when k > {_LIMB} then 1::hugeint << cast(k - {_LIMB + 1} as integer) else 0::hugeint end) as hugeint) as hi from {name}_k group by all),
    {name}_s as (select s, l, 0 as i, {_FULL('length(s)')} as s_lo, {_FULL(f'length(s) - {_LIMB}')} as s_hi from (select distinct s, l from {name}_p)
    union all select s, l, i + 1, ((s_lo + u_lo) & {_FULL('length(s)')}) | (s_lo - u_lo), ((s_hi + u_hi + ((s_lo + u_lo) >> {_LIMB})) & {_FULL(f'length(s) - {_LIMB}')}) | (s_hi - u_hi) from
      (select x.s, l, i, s_lo, s_hi, {lo} as u_lo, {hi} as u_hi from {name}_s x left join {name}_m m on m.s = x.s and m.c = substr(l, i + 1, 1) where i < length(l))),
    {name} as (select a, b, case when length(a) + length(b) = 0 then 1.0 else 2.0 * (length(s) - bit_count(s_lo) - bit_count(s_hi)) / (length(a) + length(b)) end as r
               from {name}_p join (select s, l, s_lo, s_hi from {name}_s where i = length(l)) using (s, l))"""


def _partial_sql(pairs: str, name: str) -> str:
    """CTE ``name`` (a, b, r): the best ratio of the shorter string with the windows of the longer one."""
    return f"""{name}_d as (select distinct a, b from {pairs}),
    {name}_o as (select a, b, a as x, b as y from {name}_d where length(a) <= length(b) union all select a, b, b, a from {name}_d where length(a) >= length(b)),
    {name}_t as (select a, b, x, y, unnest(range(1 - length(x), length(y))) as pos from {name}_o where x <> ''),
    {name}_w as materialized (select a as oa, b as ob, x as a, substr(y, cast(greatest(0, pos) + 1 as integer), cast(least(length(y), pos + length(x)) - greatest(0, pos) as integer)) as b from {name}_t),
    {_ratio_sql(f'{name}_w', f'{name}_r')},
    {name} as (select d.a, d.b, case when d.a = '' or d.b = '' then case when d.a = d.b then 1.0 else 0.0 end else max(r) end as r
               from {name}_d d left join {name}_w w on w.oa = d.a and w.ob = d.b left join {name}_r q on q.a = w.a and q.b = w.b group by d.a, d.b)"""


def _words_sorted(x: str) -> str:
    return f"array_to_string(list_sort(list_filter(string_split({x}, ' '), lambda t: t <> '')), ' ')"


def _token_set_sql(pairs: str, name: str) -> str:
    """CTE ``name`` (a, b, r): token-set similarity of strings a and b."""
    tokens = lambda x: f"list_distinct(list_filter(string_split({x}, ' '), lambda t: t <> ''))"
    less = lambda x, y: f"array_to_string(list_sort(list_filter({x}, lambda t: not list_contains({y}, t))), ' ')"
    both = lambda x, y: f"case when c = '' then {y} else c || ' ' || {y} end"
    return f"""{name}_t as (select a, b, {tokens('a')} as x, {tokens('b')} as y from (select distinct a, b from {pairs})),
    {name}_c as materialized (select a as oa, b as ob, len(x) = 0 or len(y) = 0 as none, array_to_string(list_sort(list_intersect(x, y)), ' ') as c, {less('x', 'y')} as l, {less('y', 'x')} as r from {name}_t),
    {name}_p as materialized (select oa, ob, {both('c', 'l')} as a, {both('c', 'r')} as b from {name}_c where not none and (c = '' or (l <> '' and r <> ''))
           union all select oa, ob, c, c || ' ' || l from {name}_c where c <> '' and l <> '' and r <> '' union all select oa, ob, c, c || ' ' || r from {name}_c where c <> '' and l <> '' and r <> ''),
    {_ratio_sql(f'{name}_p', f'{name}_r')},
    {name} as (select oa as a, ob as b, max(r) as r from (select oa, ob, r from {name}_p join {name}_r using (a, b) union all select oa, ob, 0.0 from {name}_c where none
               union all select oa, ob, 1.0 from {name}_c where not none and c <> '' and (l = '' or r = '')) group by all)"""


def _token_sort_sql(pairs: str, name: str) -> str:
    """CTE ``name`` (a, b, r): token-sort similarity of strings a and b."""
    return f"""{name}_p as materialized (select a as oa, b as ob, {_words_sorted('a')} as a, {_words_sorted('b')} as b from (select distinct a, b from {pairs})),
    {_ratio_sql(f'{name}_p', f'{name}_r')}, {name} as (select distinct oa as a, ob as b, r from {name}_p join {name}_r using (a, b))"""


def _similarity(name: str, kernel: str, sql: str | None = None):
    @query(name, sql)
    def _(spark, d):
        p = D.name_pairs(spark, d)
        return p.select("a", "b", F.round(K.kernel_scores(F.col("a"), F.col("b"), (kernel,))[kernel], 6).alias("similarity"))


_CHOSEN = "select a, b, round(r, 6) as similarity from"
_similarity("sim_ratio", "ratio", f"with recursive {D.NAME_PAIRS}, {_ratio_sql('pairs')} {_CHOSEN} rt")
_similarity("sim_token_sort", "token_sort", f"with recursive {D.NAME_PAIRS}, {_token_sort_sql('pairs', 'tz')} {_CHOSEN} tz")
_similarity("sim_token_set", "token_set", f"with recursive {D.NAME_PAIRS}, {_token_set_sql('pairs', 'te')} {_CHOSEN} te")
_similarity("sim_partial", "partial", f"with recursive {D.NAME_PAIRS}, {_partial_sql('pairs', 'pt')} {_CHOSEN} pt")
_similarity(
    "sim_partial_sort",
    "partial_sort",
    f"""with recursive {D.NAME_PAIRS}, sp as (select a as x, b as y, {_words_sorted('a')} as a, {_words_sorted('b')} as b from pairs), {_partial_sql('sp', 'pt')}
    select x as a, y as b, round(r, 6) as similarity from sp join pt using (a, b)""",
)
_similarity("sim_jaro_winkler", "jaro_winkler", f"with {D.NAME_PAIRS} select a, b, round(case when a = '' and b = '' then 1.0 else jaro_winkler_similarity(a, b) end, 6) as similarity from pairs")


@query("sim_levenshtein", f"with {D.NAME_PAIRS} select a, b, round(1.0 - levenshtein(a, b) / greatest(length(a), length(b), 1), 6) as similarity from pairs")
def _(spark, d):
    return D.name_pairs(spark, d).select("a", "b", F.round(K.levenshtein_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


_similarity("sim_damerau", "damerau", f"with {D.NAME_PAIRS} select a, b, round(1.0 - damerau_levenshtein(a, b) / greatest(length(a), length(b), 1), 6) as similarity from pairs")

_WORDS_CTE = f"{D.NAME_PAIRS}, wp as (select a, b, list_distinct(string_split(a, ' ')) as x, list_distinct(string_split(b, ' ')) as y from pairs)"


def _set_similarity(name: str, column, sql: str):
    @query(name, _sql(_WORDS_CTE, f"select a, b, round({sql}, 6) as similarity from wp"))
    def _(spark, d):
        p = D.name_pairs(spark, d)
        x, y = F.array_distinct(F.split("a", " ")), F.array_distinct(F.split("b", " "))
        return p.select("a", "b", F.round(column(x, y), 6).alias("similarity"))


_set_similarity("jaccard", K.jaccard, _JACCARD("x", "y"))
_set_similarity("overlap_coef", K.overlap, _OVERLAP("x", "y"))
_set_similarity("dice", K.dice, "case when len(x) + len(y) = 0 then 0.0 else 2.0 * len(list_intersect(x, y)) / (len(x) + len(y)) end")

_NUM = lambda c, e: f"case when has_a2 > 0 then ({c}) else 0.0 end as {e}"
_SET_SQL = {
    "root_exact": "case when q_name_root <> '' and q_name_root = t_name_root then 1.0 else 0.0 end",
    "first_match": "case when q_name_first <> '' and q_name_first = t_name_first then 1.0 else 0.0 end",
    "n_jaccard": "n_jaccard",
    "n_overlap": _OVERLAP("qa", "ta"),
    "n_dice": "case when len(qa) + len(ta) = 0 then 0.0 else 2.0 * len(list_intersect(qa, ta)) / (len(qa) + len(ta)) end",
    "compact_sub": "case when q_name_compact <> '' and t_name_compact <> '' and (contains(q_name_compact, t_name_compact) or contains(t_name_compact, q_name_compact)) then 1.0 else 0.0 end",
    "len_diff": "abs(length(q_name_clean) - length(t_name_clean))::double",
    "len_ratio": "case when greatest(length(q_name_clean), length(t_name_clean)) = 0 then 1.0 else least(length(q_name_clean), length(t_name_clean)) / greatest(length(q_name_clean), length(t_name_clean)) end",
    "w_diff": "abs(len(qa) - len(ta))::double",
    "has_a2": "has_a2",
    "a_jaccard": "a_jaccard",
    "a_overlap": f"has_a2 * {_OVERLAP('q_addr_tokens', 't_addr_tokens')}",
    "a_len_ratio": "case when has_a2 = 0 then 0.0 when greatest(length(q_addr_norm), length(t_addr_norm)) = 0 then 1.0 else least(length(q_addr_norm), length(t_addr_norm)) / greatest(length(q_addr_norm), length(t_addr_norm)) end",
    "num_overlap": "case when has_a2 = 0 then 0.0 when numbered then shared / len(q_addr_nums) else 0.5 end",
    "num_exact": "case when has_a2 > 0 and numbered and shared = len(q_addr_nums) and shared = len(t_addr_nums) then 1.0 else 0.0 end",
    "num_jaccard": f"case when has_a2 = 0 then 0.0 when numbered then {_JACCARD('q_addr_nums', 't_addr_nums')} else 0.5 end",
    "has_matching_num": "case when has_a2 > 0 and numbered and shared > 0 then 1.0 else 0.0 end",
    "word_overlap": "case when has_a2 = 0 then 0.0 when len(qw) > 0 then len(list_intersect(qw, tw)) / len(qw) else 0.5 end",
    "word_jaccard": f"has_a2 * {_JACCARD('qw', 'tw')}",
    "is_source2": "case when cand_id like 'S2-%' then 1.0 else 0.0 end",
    "b_rank": "rank::double",
    "score_margin": "(top_score - score) / (top_score + 1e-5)",
}


def _set_query(name: str, columns: list[str]):
    @query(name, _sql(_PAIR, f"select s1_id, cand_id, {', '.join(f'round({_SET_SQL[c]}, 6)::double as {c}' for c in columns)} from fs"))
    def _(spark, d):
        return _rounded(X.set_features(_pairs(spark, d)).select("s1_id", "cand_id", *columns), *columns)


_set_query("compact_sub", ["compact_sub"])
_set_query("len_features", ["len_diff", "len_ratio", "w_diff"])
_set_query("pair_features_sets", list(_SET_SQL))


_KERNEL_SQL = {"ratio": _ratio_sql, "token_sort": _token_sort_sql, "token_set": _token_set_sql, "partial": _partial_sql}
#: Of each pair of forms: a letter, its columns and the kernels that SQL has no function for.
_FORMS = (("n", "name_clean", ("ratio", "token_sort", "token_set", "partial")), ("m", "name_root", ("ratio", "token_sort", "token_set")), ("a", "addr_norm", ("ratio", "token_sort", "token_set", "partial")))


def _full_sql() -> str:
    """All 42 features."""
    ctes, joins = [], []
    for f, column, kernels in _FORMS:
        q, t = (f"{side}_{column}" for side in "qt")
        ctes.append(f"{f}_in as materialized (select distinct {q} as a, {t} as b from fs)")
        for k in kernels:
            ctes.append(_KERNEL_SQL[k](f"{f}_in", f"{f}_{k}"))
            joins.append(f"join {f}_{k} on {f}_{k}.a = {q} and {f}_{k}.b = {t}")
    ctes.append(f"n_sorted as materialized (select a as x, b as y, {_words_sorted('a')} as a, {_words_sorted('b')} as b from n_in), {_partial_sql('n_sorted', 'n_ps')}")
    joins.append("join (select x, y, max(r) as r from n_sorted join n_ps using (a, b) group by all) n_psx on n_psx.x = q_name_clean and n_psx.y = t_name_clean")
    own = lambda e: f"case when has_a2 > 0 then {e} else 0.0 end"
    jw = lambda x: f"case when q_{x} = '' and t_{x} = '' then 1.0 else jaro_winkler_similarity(q_{x}, t_{x}) end"
    edit = lambda f, x: f"1.0 - {f}(q_{x}, t_{x}) / greatest(length(q_{x}), length(t_{x}), 1)"
    made = dict(_SET_SQL) | {
        "n_fuzz": "n_ratio.r", "n_token_sort": "n_token_sort.r", "n_token_set": "n_token_set.r", "n_partial": "n_partial.r", "n_partial_sort": "n_psx.r",
        "n_jw": jw("name_clean"), "n_lev": edit("levenshtein", "name_clean"), "n_damerau": edit("damerau_levenshtein", "name_clean"),
        "root_fuzz": "m_ratio.r", "root_sort": "m_token_sort.r", "root_set": "m_token_set.r", "root_jw": jw("name_root"),
        "first_jw": "case when q_name_first <> '' and t_name_first <> '' then jaro_winkler_similarity(q_name_first, t_name_first) else 0.0 end",
        "a_fuzz": own("a_ratio.r"), "a_token_sort": own("a_token_sort.r"), "a_token_set": own("a_token_set.r"), "a_partial": own("a_partial.r"),
        "a_jw": own(jw("addr_norm")), "a_lev": own(edit("levenshtein", "addr_norm")),
        "name_addr_prod": "case when has_a2 > 0 then n_token_sort.r * a_token_sort.r else 0.9 * n_token_sort.r end",
    }
    columns = ", ".join(f"round({made[c]}, 6)::double as {c}" for c in X.FEATURES)
    return f"with recursive {_PAIR.strip()}, {', '.join(ctes)} select s1_id, cand_id, {columns} from fs {' '.join(joins)}"


@query("pair_features_full", _full_sql())
def _(spark, d):
    return _rounded(X.pair_features(_pairs(spark, d)), *X.FEATURES)


# Decisions


def _rule_sql(name: str, addr: str, out: str = "p") -> str:
    """CTE ``ruled``: pairs with the rule score of a query's name and address in the given forms."""
    parts = []
    for f, left, right in (("n", name, "t_name_clean"), ("a", addr, "t_addr_norm")):
        parts.append(f"{f}_in as materialized (select distinct {left} as a, {right} as b from pr), {_token_sort_sql(f'{f}_in', f'{f}_sort')}, {_token_set_sql(f'{f}_in', f'{f}_set')}")
        parts.append(f"{f}_best as (select a, b, greatest({f}_sort.r, 0.95 * {f}_set.r) as r from {f}_sort join {f}_set using (a, b))")
    none = f"{addr} in ('', 'null') or t_addr_norm in ('', 'null')"
    score = f"case when {none} then 0.9 * n.r when round(a.r, 9) >= 0.9 and round(n.r, 9) >= 0.5 then (n.r + a.r) / 2 else 0.6 * n.r + 0.4 * a.r end"
    return f"{', '.join(parts)}, ruled as (select pr.*, {score} as {out} from pr join n_best n on n.a = {name} and n.b = t_name_clean join a_best a on a.a = {addr} and a.b = t_addr_norm)"


_PR = _PAIR[: _PAIR.index(",\nps as")].strip()
_RULED = f"with recursive {_PR}, {_rule_sql('q_name_clean', 'q_addr_clean')}"


def _gate_sql(source: str, threshold: float, least_best: float) -> str:
    return f"select s1_id, cand_id, round(p, 6) as p from (select *, max(p) over (partition by s1_id) as best from {source}) where round(best, 9) >= {least_best} and round(p, 9) >= {threshold}"


@query("rule_score", f"{_RULED} select s1_id, cand_id, round(p, 6) as p from ruled")
def _(spark, d):
    return M.rule_score(_pairs(spark, d)).select("s1_id", "cand_id", F.round("p", 6).alias("p"))


@query("rule_combine", _sql(_SCORED.replace("scored as", "unused as"), "select s1_id, cand_id, round(case when has_a2 = 0 then 0.9 * n_jaccard when round(a_jaccard, 9) >= 0.9 and round(n_jaccard, 9) >= 0.5 then (n_jaccard + a_jaccard) / 2 else 0.6 * n_jaccard + 0.4 * a_jaccard end, 6) as p from fs"))
def _(spark, d):
    f = X.set_features(_pairs(spark, d))
    return f.select("s1_id", "cand_id", F.round(M.combine(F.col("n_jaccard"), F.col("a_jaccard"), F.col("has_a2") > 0), 6).alias("p"))


@query("rule_match", f"{_RULED} {_gate_sql('ruled', 0.74, 0.78)}")
def _(spark, d):
    return M.rule_match(M.rule_score(_pairs(spark, d))).select("s1_id", "cand_id", F.round("p", 6).alias("p"))


_HYBRID = f"with recursive {_PR}, {_rule_sql("lower(coalesce(q_name, ''))", "lower(coalesce(q_address, ''))", 'p_rule')}, mixed as (select s1_id, cand_id, 0.5 * p_rule + 0.5 * (25 - rank) / 25.0 as p from ruled)"


@query("hybrid_rule", f"{_HYBRID} {_gate_sql('mixed', 0.85, 0.87)}")
def _(spark, d):
    """The hybrid matcher's rule half, and its stand-in model score 25 - rank as a share of 25."""
    p = M.rule_score(_pairs(spark, d), raw_query=True, column="p_rule").withColumn("p_model", (25 - F.col("rank")) / 25)
    return M.hybrid(p).select("s1_id", "cand_id", _six_places(F.col("p")).alias("p"))


@query("rule_gate", _sql(_SCORED, "select s1_id, cand_id, p from (select *, max(p) over (partition by s1_id) as best from scored) where best >= 0.78 and p >= 0.74"))
def _(spark, d):
    return M.rule_match(_scored(_written(spark, d))).select("s1_id", "cand_id", "p")


@query("hybrid_gate", _sql(_SCORED, "select s1_id, cand_id, p from (select *, max(p) over (partition by s1_id) as best from (select s1_id, cand_id, 0.5 * p + 0.5 * round(1 - rank / 25, 9) as p from scored)) where round(best, 9) >= 0.72 and round(p, 9) >= 0.7").replace("select s1_id, cand_id, p from (select *, max(p)", "select s1_id, cand_id, round(p, 6) as p from (select *, max(p)"))
def _(spark, d):
    s = _scored(_written(spark, d)).withColumns({"p_model": F.col("p"), "p_rule": F.round(1 - F.col("rank") / 25, 9)})
    return M.hybrid(s, 0.7, 0.02).select("s1_id", "cand_id", F.round("p", 6).alias("p"))


@query("singleton_gate", _sql(_KEPT, "select s1_id, cand_id, p from kept"))
def _(spark, d):
    return _kept(_written(spark, d)).select("s1_id", "cand_id", "p")


@query("match_output", _sql(_KEPT, "select entity_id as source1_entity_id, coalesce(ids, '') as matched_entity_ids from ent left join (select s1_id, string_agg(cand_id, ',' order by rank) as ids from kept group by s1_id) on s1_id = entity_id where entity_id like 'S1-%'"))
def _(spark, d):
    n = _written(spark, d)
    return M.output_rows(n.filter(D.is_query()), _kept(n))


@query("candidate_output", _sql(_CAND, "select entity_id as source1_entity_id, coalesce(ids, '') as candidate_entity_ids from ent left join (select s1_id, string_agg(cand_id, ',' order by rank) as ids from cand group by s1_id) on s1_id = entity_id where entity_id like 'S1-%'"))
def _(spark, d):
    n = _written(spark, d)
    return M.output_rows(n.filter(D.is_query()), _cands(n), "candidate_entity_ids")


_PLACE = "cast(right(source1_entity_id, 6) as int) % 7"
#: Faults by an id's last digits: rows go, come twice, have an unknown id or a repeated one.
_FAULTY = f"""case {_PLACE} when 2 then concat_ws(',', case when matched_entity_ids = '' then null else matched_entity_ids end, 'S9-000000')
when 3 then concat_ws(',', case when matched_entity_ids = '' then null else matched_entity_ids end, 'S3-000002', 'S3-000002') else matched_entity_ids end"""
_VALIDATE = f"""{_KEPT},
mo as (select entity_id as source1_entity_id, coalesce(ids, '') as matched_entity_ids from ent left join (select s1_id, string_agg(cand_id, ',' order by rank) as ids from kept group by s1_id) on s1_id = entity_id where entity_id like 'S1-%'),
bad as (select source1_entity_id, {_FAULTY} as matched_entity_ids from mo where {_PLACE} <> 0 union all select * from mo where {_PLACE} = 1),
ex as (select source1_entity_id, unnest(list_filter(string_split(matched_entity_ids, ','), lambda x: x <> '')) as id from bad)
select (select count(*) from ent where entity_id like 'S1-%' and entity_id not in (select source1_entity_id from bad)) as missing_rows,
       (select count(*) from (select source1_entity_id from bad group by 1 having count(*) > 1)) as repeated_rows,
       (select count(*) from ex where not exists (select 1 from cand where s1_id = source1_entity_id and cand_id = id)) as not_candidates,
       (select count(*) from ex where id not in (select entity_id from ent where entity_id not like 'S1-%')) as unknown_ids,
       (select count(*) from (select 1 from ex group by source1_entity_id, id having count(*) > 1)) as repeated_ids"""


@query("validate_output", f"with {_VALIDATE.strip()}")
def _(spark, d):
    """The check of outputs in which faults are planted. Candidates and rows, which the check reads several times, are tables."""
    n = _written(spark, d)
    q, found = n.filter(D.is_query()), materialise(_cands(n), "candidates")
    rows = materialise(M.output_rows(q, _kept(n, found)), "rows")
    bad = rows.filter(f"{_PLACE} <> 0").select("source1_entity_id", F.expr(_FAULTY).alias("matched_entity_ids")).unionByName(rows.filter(f"{_PLACE} = 1"))
    return M.validate(bad, found.select(F.col("s1_id").alias("source1_entity_id"), F.col("cand_id").alias("id")), q, n.filter(~D.is_query()))


# Evaluation


def _entities_scored(spark, d) -> DataFrame:
    n = _written(spark, d)
    return E.entity_f05(D.truth(n), _kept(n))


@query("entity_f05", _sql(_F05, "select s1_id, round(precision, 6) as precision, round(recall, 6) as recall, round(f05, 6) as f05 from es"))
def _(spark, d):
    return _rounded(_entities_scored(spark, d), "precision", "recall", "f05").select("s1_id", "precision", "recall", "f05")


@query("macro_f05", _sql(_F05, "select round(avg(precision), 6) as macro_precision, round(avg(recall), 6) as macro_recall, round(avg(f05), 6) as macro_f05, count(*) as total_entities, count(*) filter (where n_true = 0) as singleton_count, round(coalesce(avg(case when n_pred = 0 then 1.0 else 0.0 end) filter (where n_true = 0), 1.0), 6) as singleton_accuracy from es"))
def _(spark, d):
    return _rounded(E.macro(_entities_scored(spark, d)), "macro_precision", "macro_recall", "macro_f05", "singleton_accuracy")


@query("f05_rollup", _sql(_F05, "select case when grouping(country) = 1 then 'ALL' else country end as country, round(avg(f05), 6) as macro_f05, count(*) as total_entities from es group by rollup (country)"))
def _(spark, d):
    return _rounded(E.f05_rollup(_entities_scored(spark, d)), "macro_f05")


@query("candidate_recall", _sql(f"{_CAND}, {D.TRUTH}", "select f.n as found, t.n as total, round(case when t.n = 0 then 0.0 else f.n / t.n end, 6) as recall, round((select count(*) from cand) / (select count(*) from truth), 6) as mean_candidates from (select count(*) as n from (select distinct s1_id, cand_id from tp) join cand using (s1_id, cand_id)) f, (select count(*) as n from (select distinct s1_id, cand_id from tp)) t"))
def _(spark, d):
    n = _written(spark, d)
    return _rounded(E.candidate_recall(D.truth(n), materialise(_cands(n), "candidates")), "recall", "mean_candidates")


_GRID = E.grid(0.30, 0.95, 0.05)
_GRID_SQL = f"""{_SCORED}, {D.TRUTH},
g as (select unnest([{', '.join(f'{v}::double' for v in _GRID)}]) as threshold),
sb as (select scored.*, max(p) over (partition by s1_id) as best, exists (select 1 from tp where tp.s1_id = scored.s1_id and tp.cand_id = scored.cand_id) as hit from scored),
gc as (select s1_id, threshold, count(*) as n, count(*) filter (where hit) as h from sb, g where round(best, 9) >= round(threshold + {MARGIN}, 9) and round(p, 9) >= threshold group by all),
en as (select truth.s1_id, country, threshold, len(matches) as n_true, coalesce(n, 0) as n_pred, coalesce(h, 0) as tp from truth cross join g left join gc using (s1_id, threshold)),
es as (select *, {_SCORES} from en), gr as (select country, threshold, avg(f05) as macro_f05 from es group by all)"""


def _grid(spark, d) -> DataFrame:
    n = _written(spark, d)
    return E.threshold_grid(D.truth(n), _scored(n), _GRID, MARGIN)


@query("threshold_grid", _sql(_GRID_SQL, "select country, threshold, round(macro_f05, 6) as macro_f05 from gr"))
def _(spark, d):
    return _rounded(_grid(spark, d), "macro_f05")


_BEST_SQL = f"{_GRID_SQL}, be as (select country, case when macro_f05 > 0 then threshold else 0.85 end as threshold from (select *, row_number() over (partition by country order by round(macro_f05, 12) desc, threshold) as r from gr) where r = 1)"


@query("best_thresholds", _sql(_BEST_SQL, "select country, threshold from be"))
def _(spark, d):
    return E.best_thresholds(_grid(spark, d)).select("country", "threshold")


@query("guard_threshold", _sql(_BEST_SQL, "select round(max(threshold) + 0.02, 2) as threshold from be where country in ('en', 'de')"))
def _(spark, d):
    return E.guard(E.best_thresholds(_grid(spark, d)), ("en", "de"))


@query(
    "calibrated_f05",
    _sql(
        _BEST_SQL,
        f""", lm as (select s1_id, coalesce(threshold, 0.88) as t from truth left join be using (country)),
        kp as (select s1_id, cand_id, hit from (select sb.*, t from sb join lm using (s1_id)) where round(best, 9) >= round(t + {MARGIN}, 9) and round(p, 9) >= round(t, 9)),
        eo as (select truth.s1_id, len(matches) as n_true, coalesce(n, 0) as n_pred, coalesce(h, 0) as tp from truth left join (select s1_id, count(*) as n, count(*) filter (where hit) as h from kp group by s1_id) using (s1_id)),
        so as (select *, {_SCORES} from eo)
        select round(avg(precision), 6) as macro_precision, round(avg(recall), 6) as macro_recall, round(avg(f05), 6) as macro_f05, count(*) as total_entities,
        count(*) filter (where n_true = 0) as singleton_count, round(coalesce(avg(case when n_pred = 0 then 1.0 else 0.0 end) filter (where n_true = 0), 1.0), 6) as singleton_accuracy from so""",
    ),
)
def _(spark, d):
    """Macro scores at the calibrated thresholds."""
    n = _written(spark, d)
    t, scored = D.truth(n), materialise(_scored(n), "scored")
    out = E.overall(t, scored, E.best_thresholds(E.threshold_grid(t, scored, _GRID, MARGIN)), MARGIN)
    return _rounded(out, "macro_precision", "macro_recall", "macro_f05", "singleton_accuracy")


# Training data and samples

_ORDER = lambda c: f"md5({c} || '#42')"
_LABELLED = f"{_CAND}, {D.TRUTH}, lab as (select cand.*, case when exists (select 1 from tp where tp.s1_id = cand.s1_id and tp.cand_id = cand.cand_id) then 1 else 0 end as label from cand)"


def _labelled(spark, d) -> DataFrame:
    n = _written(spark, d)
    return S.pair_labels(_cands(n), D.truth(n))


@query("train_split", _sql(D.ENTITIES, f"select entity_id as s1_id, row_number() over (order by {_ORDER('entity_id')}) <= {N_TRAIN} as is_train from ent where entity_id like 'S1-%'"))
def _(spark, d):
    return S.train_split(D.entities(spark, d).filter(D.is_query()).select(F.col("entity_id").alias("s1_id")), N_TRAIN)


@query("pair_labels", _sql(_LABELLED, "select s1_id, cand_id, label from lab"))
def _(spark, d):
    return _labelled(spark, d).select("s1_id", "cand_id", "label")


@query("label_balance", _sql(_LABELLED, "select label, count(*) as n from lab group by label"))
def _(spark, d):
    return _labelled(spark, d).groupBy("label").agg(F.count("*").alias("n"))


@query("hard_negatives", _sql(_LABELLED, "select s1_id, cand_id, label from (select *, row_number() over (partition by s1_id, label order by rank) as r from lab) where label = 1 or r <= 3"))
def _(spark, d):
    return S.hard_negatives(_labelled(spark, d)).select("s1_id", "cand_id", "label")


_BUCKETS = f"{D.ENTITIES}, {D.TRUTH}, bk as (select s1_id, coalesce(country, 'Unknown') as country, cast(least(len(matches), 5) as integer) as bucket from truth)"
_SAMPLED = f"""{_BUCKETS}, sm as (select s1_id, country, bucket from (select *, row_number() over (partition by country, bucket order by {_ORDER('s1_id')}, s1_id) as r, count(*) over (partition by country, bucket) as n from bk)
where r <= floor(n / (select count(*) from bk) * {SAMPLE}))"""
_TOPPED = f"{_SAMPLED}, tf as (select s1_id from sm union all (select s1_id from bk where s1_id not in (select s1_id from sm) order by {_ORDER('s1_id')}, s1_id limit greatest(0, {SAMPLE} - (select count(*) from sm))))"


def _buckets(spark, d) -> DataFrame:
    return S.match_buckets(D.truth(D.entities(spark, d)))


def _sample(spark, d) -> DataFrame:
    return S.stratified(_buckets(spark, d), SAMPLE)


def _topped(spark, d) -> DataFrame:
    return S.top_off(_sample(spark, d), _buckets(spark, d).select("s1_id"), SAMPLE)


@query("match_buckets", _sql(_BUCKETS, "select s1_id, country, bucket from bk"))
def _(spark, d):
    return _buckets(spark, d)


@query("strat_sample", _sql(_SAMPLED, "select s1_id, country, bucket from sm"))
def _(spark, d):
    return _sample(spark, d)


@query("strat_topoff", _sql(_TOPPED, "select s1_id from tf"))
def _(spark, d):
    return _topped(spark, d)


@query("val_ground_truth", _sql(_TOPPED, "select s1_id, array_to_string(matches, ',') as matched_entity_ids from truth where s1_id in (select s1_id from tf)"))
def _(spark, d):
    kept = D.truth(D.entities(spark, d)).join(_topped(spark, d), "s1_id", "left_semi")
    return kept.select("s1_id", F.array_join("matches", ",").alias("matched_entity_ids")).orderBy("s1_id")


@query("val_s1", _sql(_TOPPED, "select entity_id, name, address, country from ent where entity_id in (select s1_id from tf)"))
def _(spark, d):
    return D.entities(spark, d).join(_topped(spark, d).select(F.col("s1_id").alias("entity_id")), "entity_id", "left_semi")


@query("distractor_sample", _sql(_TOPPED, f"""select entity_id, name, address, country from ent where entity_id not like 'S1-%' and (entity_id in (select cand_id from tp where s1_id in (select s1_id from tf))
or (('0x' || left({_ORDER('entity_id')}, 8))::bigint % 100) < 5)"""))
def _(spark, d):
    e = D.entities(spark, d)
    needed = D.truth(e).join(_topped(spark, d), "s1_id", "left_semi").select(F.explode("matches").alias("cand_id"))
    return S.distractors(e.filter(~D.is_query()), needed)


# Models


def _training(norm: DataFrame, cands: DataFrame) -> DataFrame:
    """Training pairs of the first entities by hash order, as many as a production run takes; features are computed of these alone."""
    first = S.train_split(norm.filter(D.is_query()).select(F.col("entity_id").alias("s1_id")), TRAINED).filter("is_train")
    labelled = S.pair_labels(cands.join(first, "s1_id", "left_semi"), D.truth(norm))
    chosen = materialise(S.hard_negatives(labelled), "training")
    return X.pair_features(_joined(norm, chosen)).join(chosen.select("s1_id", "cand_id", "label"), ["s1_id", "cand_id"])


MOST_DISTRACTORS = 10


@query("distractor_cap", _sql(_TOPPED, f"""select entity_id, name, address, country from (select *, row_number() over (partition by needed, left(entity_id, 3) order by entity_id) as r from
(select *, entity_id in (select cand_id from tp where s1_id in (select s1_id from tf)) as needed from ent where entity_id not like 'S1-%' and not (entity_id not in (select cand_id from tp where s1_id in (select s1_id from tf))
and (('0x' || left({_ORDER('entity_id')}, 8))::bigint % 100) >= 5))) where needed or r <= {MOST_DISTRACTORS}"""))
def _(spark, d):
    """Distractors with a cap for each source that is reached on small tables."""
    e = D.entities(spark, d)
    needed = D.truth(e).join(_topped(spark, d), "s1_id", "left_semi").select(F.explode("matches").alias("cand_id"))
    return S.distractors(e.filter(~D.is_query()), needed, most=MOST_DISTRACTORS)


def _tables(spark, d) -> tuple[DataFrame, DataFrame]:
    """Records and candidates, which models read for their training and again for what they score."""
    norm = _written(spark, d)
    return norm, materialise(_cands(norm), "candidates")


@query("train_gbt")
def _(spark, d):
    """Probabilities of the first model on its training pairs."""
    data = materialise(_training(*_tables(spark, d)), "features")
    return L.ensemble_score(data, L.train_ensemble(data)[:1]).select("s1_id", "cand_id", "label", "p")


@query("ensemble_score")
def _(spark, d):
    norm, found = _tables(spark, d)
    models = L.train_ensemble(_training(norm, found))
    return L.ensemble_score(X.pair_features(_joined(norm, found)), models).select("s1_id", "cand_id", "p")


@query("feature_importance")
def _(spark, d):
    return L.feature_importance(L.train_ensemble(_training(*_tables(spark, d)))[0], spark)
