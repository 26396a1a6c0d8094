from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stationlake.functions import agro, heat
from stationlake.functions.rounding import half_up, upper_median


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_half_up_below_zero(spark):
    assert [value(spark, half_up(F.lit(x), 1)) for x in (-0.25, 0.25, 1.05, -1.0)] == [-0.2, 0.3, 1.1, -1.0]


def test_upper_median(spark):
    assert value(spark, upper_median(F.array(*map(F.lit, (4, 1, 3, 2))))) == 3
    assert value(spark, upper_median(F.array().cast("array<int>"))) is None


def test_wet_bulb_example(spark):
    assert value(spark, heat.stull_wet_bulb(F.lit(20.0), F.lit(50.0))) == pytest.approx(13.7, abs=0.05)


def test_heat_index_forms(spark):
    """Simple below a mean of 80 F; the regression's published example is 90 F at 70 % giving 106 F."""
    hot = value(spark, heat.heat_index(F.lit((90 - 32) / 1.8), F.lit(70.0)))
    assert hot * 1.8 + 32 == pytest.approx(106, abs=0.5)
    assert value(spark, heat.heat_index(F.lit(15.0), F.lit(50.0))) < 16


@pytest.mark.parametrize("wbgt,offset,band", [(17.99, 0, "LOW"), (18.0, 0, "ELEVATED"), (21.0, 0, "HIGH"), (24.0, 0, "VERY_HIGH"), (24.0, 2, "HIGH"), (22.5, -1.5, "VERY_HIGH")])
def test_bands_at_their_edges(spark, wbgt, offset, band):
    assert value(spark, heat.risk_band(F.lit(wbgt), float(offset))) == band


def test_band_of_nothing(spark):
    assert value(spark, heat.risk_band(F.lit(None).cast("double"))) is None


@pytest.mark.parametrize("rain,soil,want", [(None, 0.3, None), (30, None, None), (30, 0.25, "HIGH"), (30, 0.2, "ELEVATED"), (15, None, "ELEVATED"), (5, None, None), (5, 0.3, "ELEVATED"), (5, 0.1, "LOW"), (4.9, None, "LOW")])
def test_flood_has_three_values(spark, rain, soil, want):
    d = lambda x: F.lit(x).cast("double")
    assert value(spark, heat.flood_risk(d(rain), d(soil))) == want


def test_radiation_golden(spark):
    assert value(spark, agro.extraterrestrial_radiation_mm(F.lit(264), -1.0997)) == pytest.approx(15.25, abs=0.01)


@pytest.mark.parametrize("stage,full,want", [("establishment", 1.0, 0.3), ("vegetative", 1.0, 0.65), ("flowering", 1.0, 1.0), ("establishment", 0.4, 0.2)])
def test_roots(spark, stage, full, want):
    assert value(spark, agro.root_depth(F.lit(full), F.lit(stage))) == want


@pytest.mark.parametrize("mm,want", [(2.0, 0.0), (10.0, 8.0), (None, None)])
def test_effective_rain(spark, mm, want):
    assert value(spark, agro.effective_rain(F.lit(mm).cast("double"))) == want


def test_sun_at_the_equator(spark):
    sun = agro.sun_minutes(F.lit(80))
    rise, set_ = value(spark, sun["sunrise"]), value(spark, sun["sunset"])
    assert set_ - rise == pytest.approx(727, abs=3)
    assert (rise + 180) / 60 == pytest.approx(6.6, abs=0.2)


#: air, humidity, pressure, wind, light, direct share, cosine -> globe, natural and psychrometric wet bulb, WBGT
OUTDOOR = [
    ((28, 40, 852, 1.0, 900, 0.712765, 0.986814), (48.3233, 21.5639, 17.7491, 27.5594)),
    ((15, 85, 852, 0.0, 0, 0, -0.992678), (12.3539, 12.7179, 13.3787, 12.8733)),
    ((33, 65, 1010, 2.5, 950, 0.725457, 0.999403), (48.1206, 28.8586, 27.216, 33.1251)),
    ((38, 15, 950, 6.0, 800, 0.67627, 0.867033), (46.9492, 19.7904, 18.253, 27.0431)),
    ((16, 80, 852, 0.5, 200, 0.586275, 0.245834), (26.1289, 16.3478, 13.7475, 18.2693)),
    ((21, 70, 852, 1.5, 300, 0.010073, 0.987832), (28.5064, 18.8612, 17.0519, 21.0041)),
    ((26, 50, 852, 1.0, 1125.692505, 0.9, 0.986814), (49.7022, 21.7798, 18.1285, 27.7863)),
]


def test_outdoor_heat_golden(spark):
    from stationlake.functions import liljegren

    names = ["air", "rh", "p", "wind", "solar", "direct", "cosine"]
    rows = [(k, *map(float, i)) for k, (i, _) in enumerate(OUTDOOR)] + [(9, None, 50.0, 850.0, 1.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "k int, " + ", ".join(f"{n} double" for n in names))
    got = {r["k"]: r["w"] for r in df.select("k", liljegren.wbgt_outdoor(*names).alias("w")).collect()}
    for k, (_, want) in enumerate(OUTDOOR):
        assert tuple(got[k]) == pytest.approx(want, abs=0.02)
    assert got[9]["wbgt"] is None


@pytest.mark.parametrize("question,want", [("When should I spray my maize?", "spray"), ("Will it RAIN", "rain"), ("best time to walk", "best_time"), ("hello", "overview"), (None, "overview"), ("Je, mvua itanyesha?", "rain")])
def test_intents(spark, question, want):
    from stationlake.functions import text

    assert value(spark, text.intent(F.lit(question).cast("string"))) == want


@pytest.mark.parametrize("number,good", [("24", True), ("23.9", True), ("23.8", False), ("26", True), ("19.8", False)])
def test_grounding_rounds_as_written(spark, number, good):
    from stationlake.functions import text

    assert value(spark, text.grounded(F.lit(number), F.array(F.lit(23.9), F.lit(-26.0), F.lit(19.5)))) is good


def test_templates_and_references(spark):
    from stationlake.functions import text

    assert value(spark, text.fill(F.lit("{a} at {b}"), a=F.lit("x"), b=F.lit("y"))) == "x at y"
    assert value(spark, text.escape_html(F.lit("<a & 'b'>"))) == "&lt;a &amp; &#39;b&#39;&gt;"


def test_sun_overhead_and_distance(spark):
    """At the June solstice noon the sun stands 23.44 degrees north; it is nearest in early January."""
    import math

    from stationlake.functions import sun

    june, january = 1_750_507_200, 1_735_905_600  # 2025-06-21 12:00 UTC, 2025-01-03 12:00 UTC
    cosine, far = sun.position(F.lit(june), latitude=23.44, longitude=0.0)
    assert value(spark, cosine) == pytest.approx(1, abs=2e-4)
    assert value(spark, far) == pytest.approx(1.0163, abs=5e-4)
    assert value(spark, sun.position(F.lit(january))[1]) == pytest.approx(0.9833, abs=5e-4)
    night = sun.position(F.lit(june), latitude=0.0, longitude=180.0)[0]
    assert value(spark, night) == pytest.approx(-math.cos(math.radians(23.44)), abs=1e-3)


def test_hourly_mean_of_a_rising_sun(spark):
    from stationlake.functions import sun

    sunrise = 1_750_507_200 - 12 * 3600 + 6 * 3600
    mean = value(spark, sun.hourly_mean(F.lit(sunrise), latitude=0.0, longitude=0.0))
    assert 0 < mean < value(spark, sun.position(F.lit(sunrise + 3600), latitude=0.0, longitude=0.0)[0])


@pytest.mark.parametrize("x,want", [(None, "grey"), (13.9, "#ECA47F"), (14.0, "#E28755"), (99.0, "#822F00")])
def test_colours(spark, x, want):
    from stationlake.functions import sun

    assert value(spark, sun.colour(F.lit(x).cast("double"), "temperature", "grey")) == want
