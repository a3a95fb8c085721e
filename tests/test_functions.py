"""Golden values of pure expressions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from trifold.functions import expr, text
from trifold.operators import power


@pytest.fixture
def one(spark):
    return lambda *cols: tuple(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(cols)]).first())


def test_match_key(one):
    tags = F.array(*map(F.lit, ["#FFF", "aaa", " #bbb ", "#CCC", "#DDD", "#EEE"]))
    assert one(expr.match_key(F.lit("20260804T131108.000Z"), tags)) == ("dd7be983b2bc608a563b58d61c45154637c08091",)


def test_tags(one):
    assert one(expr.norm_tag(F.lit(" abc ")), expr.norm_tag(F.lit("#abc")), expr.norm_tag(F.lit(" # "))) == ("#ABC", "#ABC", None)


@pytest.mark.parametrize(("i", "j", "want"), [(0, 1, 0), (1, 0, 0), (0, 106, 105), (1, 2, 106), (105, 106, 5670)])
def test_pair_index(one, i, j, want):
    assert one(expr.pair_index(F.lit(i), F.lit(j))) == (want,)


def test_wilson(one):
    assert one(*expr.wilson(F.lit(60), F.lit(100))) == pytest.approx((0.502000785, 0.690600254), abs=1e-8)
    assert one(*expr.wilson(F.lit(0), F.lit(10))) == pytest.approx((0, 0.277540169), abs=1e-8)


def test_normal(one):
    got = one(*[expr.norm_cdf(F.lit(x)) for x in (1.96, -1.0, 0.0)], expr.erf(F.lit(0.5)), expr.erf(F.lit(-0.5)))
    assert got == pytest.approx((0.97500217, 0.15865526, 0.49999999948, 0.5205000163, -0.5205000163), abs=1e-8)


def test_uniform(one):
    assert one(expr.uniform(20260805, F.lit(0)), expr.uniform(20260805, F.lit(1))) == (0.014530243119224906, 0.4852289955597371)


def test_explore_share(one):
    assert one(*[expr.explore_share(F.lit(n), F.lit(10000)) for n in (0, 5000, 10000, 20000)]) == (0.2, 0.125, 0.05, 0.05)


def test_priority(one):
    got = one(expr.priority(F.lit(10.0), F.lit(1.0), F.lit(7200), F.lit(0.0)), expr.priority(F.lit(0.1), F.lit(0.0), F.lit(0), F.lit(1.0)))
    assert got == pytest.approx((11.8, -1.1))


def test_compact_timestamp(one):
    good, bad = one(F.unix_timestamp(expr.compact_timestamp(F.lit("20260804T131108.000Z"))), expr.compact_timestamp(F.lit("soon")))
    assert good == 1785849068 and bad is None


@pytest.mark.parametrize(("result", "change", "mine", "want"), [("victory", None, 0, 0), ("defeat", 5, 0, 1), ("draw", 8, 0, None), (None, 8, 1, 1), (None, -8, 1, 0), (None, 0, 1, None), ("odd", 8, 1, None)])
def test_winner(one, result, change, mine, want):
    assert one(expr.winner(F.lit(result).cast("string"), F.lit(change).cast("int"), F.lit(mine))) == (want,)


def test_sigmoid_is_stable(one):
    assert one(expr.sigmoid(F.lit(-900.0)), expr.sigmoid(F.lit(900.0)), expr.sigmoid(F.lit(0.0))) == (0.0, 1.0, 0.5)


def test_texts(one):
    t = F.lit("{{Map|map= Hard  Rock <!--x-->\n|T1C1=a|score1=}}")
    assert one(text.template_field(t, "map"), text.template_field(t, "t1c1"), text.template_field(t, "score1"), text.template_field(t, "none")) == ("Hard Rock", "a", None, None)
    nested = F.lit("{{Map|map={{Link|A|t1c1=no}}|t1c1=[[x|y]]|maptype=\n ball\n|score1=2}}")
    assert one(text.template_field(nested, "map"), text.template_field(nested, "t1c1"), text.template_field(nested, "maptype"), text.template_field(nested, "score1")) == ("{{Link|A|t1c1=no}}", "[[x|y]]", "ball", "2")
    assert one(text.stamp(F.lit(75)), text.clean_caption(F.lit("<i>so</i>  {x} it"))) == ("[01:15]", "so it")
    assert "el primos" not in one(text.alias_variants(F.lit("El-Primo")))[0]
    assert {"el-primo", "elprimo", "el primo", "elprimos", "elprimo's"} == set(one(text.alias_variants(F.lit("El-Primo")))[0])


def test_tier(one):
    assert one(*[expr.tier(F.lit(r)) for r in (0, 1, 10, 22, 40)]) == (None, "bronze", "diamond", "pro", "pro")


def test_power():
    assert power.chi2_cdf(power.chi2_quantile(0.95, 1), 1) == pytest.approx(0.95)
    assert power.chi2_quantile(0.95, 1) == pytest.approx(3.841459, abs=1e-5)
    assert power.power(1, 7.849, 0.05) == pytest.approx(0.8, abs=0.02)
    n = power.matches_needed(106, 0.1, 0.05)
    assert power.power(106, n * 0.1 / 4, 0.05) >= 0.8 > power.power(106, (n - 2) * 0.1 / 4, 0.05)
    assert power.sigma_from_auc(0.66) == pytest.approx(0.6, abs=0.08)


def test_p_of_interval(spark):
    from trifold.functions.expr import p_of_interval

    rows = spark.createDataFrame([(1.96, 0.0, 3.92), (0.0, -1.0, 1.0), (0.3, 0.3, 0.3)], "v double, low double, high double")
    got = [r[0] for r in rows.select(p_of_interval("v", "low", "high")).collect()]
    assert abs(got[0] - 0.05) < 1e-4 and abs(got[1] - 1) < 1e-6 and abs(got[2] - 1) < 1e-6
