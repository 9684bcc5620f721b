import math

import pytest
from hypothesis import given
from hypothesis import settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from candor.functions import text, vector
from candor.functions.rng import uniform


def one(spark, column, **values):
    names = list(values)
    kinds = {str: "string", list: "array<double>", float: "double", int: "int"}
    schema = ", ".join(f"{n} {kinds[type(values[n])]}" for n in names) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("r")).first().r


def test_stopwords():
    assert len(text.STOPWORDS) == len(set(text.STOPWORDS)) == 127
    assert {"s", "t", "don"} <= set(text.STOPWORDS)


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("Don't (stop) me_now\tNOW", ["don", "t", "stop", "me", "now", "now"]),
        ("", []),
        (" \n\x0b\f\r\t ", []),
        ("Été ÉTÉ d'A", ["Été", "ÉtÉ", "d", "a"]),
        ("a b", ["a b"]),
    ],
)
def test_tokens(spark, raw, expected):
    assert one(spark, text.tokens(F.col("c")), c=raw) == expected


def test_null_answer_has_no_tokens(spark):
    assert spark.sql("select cast(null as string) c").select(F.explode(text.tokens(F.col("c")))).count() == 0


@pytest.mark.parametrize("word", ["abc", "abcd", "abcde"])
def test_pad_and_back(spark, word):
    padded = one(spark, text.pad(F.col("c"), F.lit(8)), c=word)
    assert len(padded) == 8 and one(spark, text.unpad(F.col("c")), c=padded) == word


def test_strip_id(spark):
    assert one(spark, text.strip_id(F.col("c")), c="  11.10  what   is\ta stack ") == "what is a stack"


def test_vectors(spark):
    a, b = F.col("a"), F.col("b")
    v = dict(a=[3.0, 4.0], b=[1.0, -2.0])
    assert one(spark, vector.dot(a, b), **v) == -5
    assert one(spark, vector.norm(a), **v) == 5
    assert one(spark, vector.add(a, b), **v) == [4, 2]
    assert one(spark, vector.subtract(a, b), **v) == [2, 6]
    assert one(spark, vector.scale(a, 2.0), **v) == [6, 8]
    assert one(spark, vector.normalised(a), **v) == pytest.approx([0.6, 0.8])
    assert one(spark, vector.normalised(F.array(F.lit(0.0))), **v) == [None]
    assert one(spark, vector.distance(vector.normalised(a), vector.normalised(a)), **v) == pytest.approx(0, abs=1e-12)


def test_vmf(spark):
    def s(k, a, b):
        u = math.sqrt(k * k + b * b)
        return u - b - (0 if a == 0 else a * math.log((a + u) / (a + b)))

    for kappa, d in ((5.0, 10), (100.0, 2), (0.5, 200)):
        nu = d / 2 - 1
        low = min(kappa, math.sqrt((3 * nu + 5.5) * (nu + 1.5)))
        expected = s(kappa, nu + 0.5, nu + 0.5) + s(low, nu, nu + 2) - s(low, nu + 0.5, nu + 0.5)
        assert one(spark, vector.vmf_log_constant(F.col("k"), F.col("d")), k=kappa, d=d) == pytest.approx(expected)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=20))
def test_uniform_is_a_function_of_ids(spark, ids):
    df = spark.createDataFrame([(i,) for i in ids], "i long").select("i", uniform("s", "i").alias("u"))
    rows = df.collect()
    assert all(0 <= r.u < 1 for r in rows)
    assert len({r.u for r in rows}) == len(set(ids))
