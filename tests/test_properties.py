"""Property tests: expressions against plain-Python statements of the rules."""

from decimal import ROUND_HALF_UP, Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from gatewatch.functions import parse_number_br, retention_rate

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def half_up_pct(m: int, t: int) -> float:
    if t == 0:
        return 0.0
    return float((Decimal(m) * 100 / Decimal(t)).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP))


@SETTINGS
@given(st.lists(st.one_of(
    st.tuples(st.integers(0, 10**17), st.integers(0, 10**17)),
    # exact ties: half a hundredth of a percent
    st.integers(1, 10**13).map(lambda k: (19999 * k, k)), st.integers(1, 10**13).map(lambda k: (19993 * k, 7 * k))),
    min_size=1, max_size=200))
def test_retention_rate_is_exact_half_up(spark, pairs):
    df = spark.createDataFrame(pairs, "released long, retained long")
    got = [r[0] for r in df.select(retention_rate("released", "retained")).collect()]
    assert got == [half_up_pct(m, r + m) for r, m in pairs]


def br_text(cents: int) -> str:
    whole, frac = divmod(abs(cents), 100)
    groups = f"{whole:,}".replace(",", ".")
    return ("-" if cents < 0 else "") + f"{groups},{frac:02d}"


@SETTINGS
@given(st.lists(st.integers(-10**11, 10**11), min_size=1, max_size=60))
def test_parse_number_br_round_trips(spark, values):
    df = spark.createDataFrame([(br_text(v),) for v in values], "v string")
    got = [r[0] for r in df.select(parse_number_br("v")).collect()]
    assert got == [float(Decimal(v) / 100) for v in values]
