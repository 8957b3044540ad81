import datetime as dt
import hashlib
import hmac
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from deedwork.functions import crypto, grains, masks, pii
from deedwork.functions import rules as R
from deedwork.functions.durations import seconds_of


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def D(text):
    return F.lit(text).cast("date")


def null():
    return F.lit(None).cast("int")


def test_a_comparison_with_null_is_false_and_negates(spark):
    assert one(spark, R.compare(null(), "=", 1), R.compare(null(), "<>", 1), R.negate(R.compare(null(), "=", 1))) == (False, False, True)


def test_not_in_and_not_between_with_null_are_false(spark):
    got = one(
        spark,
        R.one_of(null(), [1, 2], negated=True),
        R.one_of(F.lit(3), [1, None], negated=True),
        R.between(null(), 1, 2, negated=True),
        R.between(F.lit(3), 1, 2, negated=True),
    )
    assert got == (False, True, False, True)


def test_division_by_zero_is_null(spark):
    assert one(spark, R.divide(F.lit(Decimal("1.5")), F.lit(Decimal("0")))) == (None,)


def test_rounding_modes(spark):
    half = F.lit(Decimal("2.5"))
    got = one(spark, R.round_away(half, 0), R.round_even(half, 0), R.round_away(-half, 0), R.round_even(-half, 0))
    assert [int(x) for x in got] == [3, 2, -3, -2]


@pytest.mark.parametrize(
    "start, end, months, years",
    [
        ("2024-01-31", "2024-02-29", 1, 0),
        ("2024-01-31", "2024-02-28", 0, 0),
        ("2023-01-31", "2023-02-28", 1, 0),
        ("2024-02-29", "2025-02-28", 12, 1),
        ("2024-03-15", "2024-03-14", 0, 0),
        ("2025-02-28", "2024-02-29", -12, -1),
        ("2024-05-31", "2024-03-31", -2, 0),
    ],
)
def test_whole_months(spark, start, end, months, years):
    assert one(spark, R.months_between(D(start), D(end)), R.years_between(D(start), D(end))) == (months, years)


def test_date_addition_clamps_and_leaves_the_calendar_as_null(spark):
    big = F.lit(10**15)
    got = one(
        spark,
        R.add_months(D("2001-01-31"), F.lit(1)),
        R.add_months(D("2001-02-28"), F.lit(1)),
        R.add_days(D("9999-12-31"), F.lit(1)),
        R.add_days(D("2001-01-01"), big),
        R.add_months(D("0001-01-31"), F.lit(-1)),
        R.add_years(D("2024-02-29"), F.lit(1)),
        R.add_years(D("2024-02-29"), big),
    )
    assert got == (dt.date(2001, 2, 28), dt.date(2001, 3, 28), None, None, None, dt.date(2025, 2, 28), None)


def test_an_overflow_raises(spark):
    with pytest.raises(Exception, match="NUMERIC_VALUE_OUT_OF_RANGE|ARITHMETIC_OVERFLOW"):
        one(spark, R.exact(F.lit(Decimal(10) ** 37), 4))


def test_hmac_equals_the_standard_one(spark):
    for key in (b"k", b"a-key-of-some-length" * 5):
        want = hmac.new(key, "åb".encode(), hashlib.sha256).hexdigest()
        assert one(spark, crypto.tokenize(F.lit("åb"), key)) == (want[:32],)


@pytest.mark.parametrize(
    "first, last, value, want",
    [(0, 4, "+46701234567", "********4567"), (3, 2, "+46701234567", "+46*******67"), (0, 0, "secret", "******"), (0, 4, "1234", "****"), (0, 4, "", "")],
)
def test_partial_mask(spark, first, last, value, want):
    assert one(spark, crypto.partial_mask(F.lit(value), first, last)) == (want,)


def test_shapes_match_whole_values_only(spark):
    digest = "a" * 64
    shape = crypto.shape_of("hash")
    got = one(spark, *[crypto.has_shape(F.lit(v), shape) for v in (digest, digest + "\n", "x\n" + digest)])
    assert got == (True, False, False)


def test_encryption_is_bound_to_its_column_and_fresh(spark):
    key = bytes(32)
    a, b = one(spark, crypto.encrypt(F.lit("v"), key, "c"), crypto.encrypt(F.lit("v"), key, "c"))
    assert a != b and a.startswith(crypto.ENCRYPTED_PREFIX)
    assert one(spark, crypto.decrypt(F.lit(a), key, "c")) == ("v",)
    with pytest.raises(Exception, match="AES_CRYPTO_ERROR"):
        one(spark, crypto.decrypt(F.lit(a), key, "other"))


@pytest.mark.parametrize("value, valid", [("4111 1111 1111 1111", True), ("4111111111111112", False), ("79927398713", False)])
def test_luhn(spark, value, valid):
    assert one(spark, pii.luhn(F.lit(value))) == (valid,)


@pytest.mark.parametrize(
    "column, classes",
    [
        ("email_address", ["email"]),
        ("ip_address", ["ip_address"]),
        ("user_name", ["username"]),
        ("first_name", ["name"]),
        ("order_total", []),
        ("billing_address", ["address"]),
        ("credit_card_number", ["payment_card"]),
        ("date_of_birth", ["dob"]),
        ("patient_id", ["medical"]),
        ("HOME PHONE-NUMBER", ["phone"]),
        ("remote_ip", ["ip_address"]),
        ("mac-address", ["mac_address"]),
        ("customer.zip-code", ["address"]),
        ("lat", ["geo"]),
        ("drivers_license", ["national_id"]),
        ("marital status", ["special_category"]),
        ("api_key", ["credentials"]),
        ("social security number", ["ssn"]),
        ("plate", []),
        ("shipment", []),
    ],
)
def test_column_names(column, classes):
    assert pii.name_classes(column) == classes


@pytest.mark.parametrize("text, grain", [("per month", "month"), ("Day grain", "day"), ("HRS", "hour"), ("ms", "minute"), ("fortnight", None), ("", None), (None, None)])
def test_grains(text, grain):
    assert grains.grain_of(text) == grain


def test_masks():
    assert masks.mask_regex("99A-X\\9") == r"[0-9]{2}[A-Z]\-[A-Z0-9]9"
    assert masks.identifier_regex((("MSC", "TWR"), "999")) == "^((MSC|TWR)[0-9]{3})$"
    for bad in ("abc", "9\\"):
        with pytest.raises(ValueError):
            masks.mask_regex(bad)


@pytest.mark.parametrize("text, seconds", [("24h", 86400), ("PT24H", 86400), ("P1DT1M", 86460), ("P1M", 30 * 86400), ("P2W", 14 * 86400), ("30m", 1800)])
def test_durations(text, seconds):
    assert seconds_of(text) == seconds
