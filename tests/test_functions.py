import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinmesh.functions import batch
from kinmesh.functions import kernels as K
from kinmesh.functions import text as T
from kinmesh.operators import records


def apply(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_clean_text(spark):
    values = [None, "", "null", "NULL", " null ", "Br0wn & Co.", "be1l0w be11o 10 a1", "Café-Crème, S.A.", "Straße @ Œuvre", "a_b  c\t d", "日本 x", "NULL."]
    want = ["", "", "", "", "null", "brown and co", "bellow be11o 10 a1", "cafe creme s a", "strasse at oeuvre", "a_b c d", "x", "null"]
    assert apply(spark, T.clean_text, values) == want


def test_clean_text_is_idempotent(spark):
    once = apply(spark, T.clean_text, ["Br0wn & Co.", "l0l1l0", "É'à-b"])
    assert apply(spark, T.clean_text, once) == once


def test_numbers(spark):
    assert apply(spark, T.normalize_number, ["06446", "000", "0", "12", "010"]) == ["6446", "0", "0", "12", "10"]


RECORDS = [
    ("a", "Acme Pvt Ltd", "12B St, Okhla 00120", "India"),
    ("b", "Ltd Inc", "null", "US"),
    ("c", "painterslocal46 com", "NULL.", "US"),
    ("d", None, None, None),
    ("e", "Springfield Springfield L.L.C.", "007 0 rue all", "France"),
]


def test_records(spark):
    out = {r["entity_id"]: r for r in records.normalise(spark.createDataFrame(RECORDS, "entity_id string, name string, address string, country string")).collect()}
    assert (out["a"]["name_root"], out["a"]["name_first"]) == ("acme", "acme")
    assert out["a"]["addr_norm"] == "12 b street okhla 00120" and out["a"]["addr_nums"] == ["12", "120"] and out["a"]["addr_words"] == ["okhla"]
    assert out["b"]["name_root"] == "ltd inc" and out["b"]["addr_norm"] == ""
    assert (out["c"]["name_root"], out["c"]["name_compact"], out["c"]["addr_norm"]) == ("painterslocal46 com", "painterslocal46com", "null")
    assert (out["d"]["name_clean"], out["d"]["name_first"], out["d"]["addr_words"]) == ("", "", [])
    assert out["e"]["name_root"] == "springfield springfield l l c" and out["e"]["addr_nums"] == [] and out["e"]["addr_norm"] == "007 0 rue allee"
    stripped = records.normalise(spark.createDataFrame(RECORDS, "entity_id string, name string, address string, country string"), True)
    assert stripped.filter("entity_id = 'c'").first()["name_root"] == "painterslocal46"


def test_scripts_are_romanised_in_plans(spark):
    values = ["मुंबई ट्रेडर्स", "Москва Авто", "Щёлково Ltd", "Αθήνα Ωμέγα", "カナ にほん", "plain é", "दिल्ली १२", "नमस्ते", None, ""]
    got = apply(spark, T.clean_text, values)
    assert got[1:5] == ["moskva avto", "shchelkovo ltd", "athena omega", "kana nihon"] and got[5] == "plain e" and got[7] == "namaste" and got[8:] == ["", ""]
    assert all(got[:1]) and got[0].split()[0].startswith("mu") and len(got[0].split()) == 2
    raw = apply(spark, T.romanise, values[:8])
    assert raw == [T.romanise_text(v) for v in values[:8]]


def test_romanised_scripts():
    assert T.romanise_text("नमस्ते India") == "namaste India"
    assert T.romanise_text("दिल्ली १२").startswith("dill") and T.romanise_text("दिल्ली १२").endswith("12")
    assert T.romanise_text("plain é") == "plain é"


def naive_lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            d[i][j] = d[i - 1][j - 1] + 1 if x == y else max(d[i - 1][j], d[i][j - 1])
    return d[-1][-1]


words = st.text(alphabet="abc é", max_size=14)


@settings(max_examples=300, deadline=None)
@given(words, words)
def test_kernels(a, b):
    assert K.lcs(a, b) == naive_lcs(a, b)
    for name, f in K.KERNELS.items():
        v = f(a, b)
        assert 0 <= v <= 1, name
        assert v == pytest.approx(f(b, a)), name
        if a == b and (name != "token_set" or a.split()):
            assert v == 1, name
    assert K.damerau(a, b) <= K.levenshtein(a, b)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="abcde é", max_size=80), st.text(alphabet="abcde é", max_size=80)), max_size=8))
def test_batch_kernels_equal_scalar_ones(pairs):
    a, b = [p[0] for p in pairs], [p[1] for p in pairs]
    for name, f in batch.KERNELS.items():
        assert list(f(a, b)) == pytest.approx([K.KERNELS[name](x, y) for x, y in pairs], abs=1e-12), name


def test_kernel_values():
    assert K.ratio("", "") == 1 and K.ratio("a", "") == 0 and K.ratio("abcd", "abxd") == 0.75
    assert K.token_sort("fuzzy wuzzy bear", "bear wuzzy fuzzy") == 1
    assert K.token_set("a b", "a b c") == 1 and K.token_set("", "a") == 0
    assert K.partial("abc", "xxabcxx") == 1 and K.partial("", "") == 1 and K.partial("", "a") == 0
    assert K.damerau("ca", "abc") == 2 and K.levenshtein("ca", "abc") == 3
    assert K.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert K.jaro_winkler("", "") == 1


def test_set_similarities(spark):
    rows = [(["a", "b"], ["b", "c"]), ([], []), (["a"], [])]
    df = spark.createDataFrame(rows, "x array<string>, y array<string>")
    got = [tuple(r) for r in df.select(F.round(K.jaccard(F.col("x"), F.col("y")), 4), K.overlap(F.col("x"), F.col("y")), K.dice(F.col("x"), F.col("y"))).collect()]
    assert got == [(0.3333, 0.5, 0.5), (1.0, 0.0, 0.0), (0.0, 0.0, 0.0)]


def test_latin_letters_lose_their_marks(spark):
    letters = "éÀñüçäöêíåøłž"
    assert apply(spark, T.to_ascii, [letters, unicodedata.normalize("NFD", "é")]) == ["eAnucaoeiaolz", "e"]


def test_long_strings_are_left_to_no_scalar_kernel(monkeypatch):
    a = ["x yz " * 20 + "tail", "ab" * 35, "é" * 64, "q" * 300, ""]
    b = ["tail " + "yz x " * 18, "ba" * 40, "é" * 70 + "b", "r" * 5 + "q" * 290, "abc" * 30]
    names = ("ratio", "token_sort", "token_set", "partial", "partial_sort", "jaro_winkler", "damerau")
    want = {n: [K.KERNELS[n](x, y) for x, y in zip(a, b, strict=True)] for n in names}

    def scalar(*_):
        raise AssertionError("a scalar kernel was asked")

    for n in ("ratio", "partial", "damerau"):
        monkeypatch.setattr(K, n, scalar)
    for n in names:
        assert batch.KERNELS[n](a, b).tolist() == want[n], n
