"""Check digits of Russian identifiers and address checks, as boolean Columns over strings of ASCII digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the check sums
INN10 = (2, 4, 10, 3, 5, 9, 4, 6, 8)
INN12_FIRST = (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
INN12_SECOND = (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
SNILS = (9, 8, 7, 6, 5, 4, 3, 2, 1)
ACCOUNT = (7, 1, 3) * 7 + (7, 1)
SNILS_FREE = 1_001_998


def digit(s: Column, i: int) -> Column:
    return F.try_to_number(F.substring(s, i + 1, 1), F.lit("9")).cast("int")


def weighted(s: Column, weights: tuple[int, ...]) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights):
        total = total + digit(s, i) * w
    return total


def of_digits(s: Column, *lengths: int) -> Column:
    return s.rlike("^[0-9]+$") & F.length(s).isin(*lengths)


def inn(s: Column) -> Column:
    ten = (F.length(s) == 10) & (weighted(s, INN10) % 11 % 10 == digit(s, 9))
    twelve = (F.length(s) == 12) & (weighted(s, INN12_FIRST) % 11 % 10 == digit(s, 10)) & (weighted(s, INN12_SECOND) % 11 % 10 == digit(s, 11))
    return F.coalesce(of_digits(s, 10, 12) & (ten | twelve), F.lit(False))


def ogrn(s: Column) -> Column:
    number = lambda n: F.substring(s, 1, n).try_cast("bigint")
    return F.coalesce(of_digits(s, 13, 15) & F.when(F.length(s) == 13, number(12) % 11 % 10 == digit(s, 12)).otherwise(number(14) % 13 % 10 == digit(s, 14)), F.lit(False))


def snils(s: Column) -> Column:
    total = weighted(s, SNILS)
    check = F.when(total < 100, total).when(total.isin(100, 101), F.lit(0)).otherwise(F.when(total % 101 == 100, F.lit(0)).otherwise(total % 101))
    stated = F.substring(s, 10, 2).try_cast("int")
    return F.coalesce(of_digits(s, 11) & F.when(F.substring(s, 1, 9).try_cast("int") <= SNILS_FREE, stated == 0).otherwise(check == stated), F.lit(False))


def bik(s: Column) -> Column:
    return F.substring(s, -3, 3) != "000"


kpp = bik


def account_key(account: Column, bik_: Column) -> Column:
    both = F.concat(F.substring(bik_, -3, 3), account)
    return F.coalesce(of_digits(both, 23) & (weighted(both, ACCOUNT) % 10 == 0), F.lit(False))


def ipv4(s: Column) -> Column:
    """Four octets up to 255 without leading zeros."""
    return s.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.(?!$)|$)){4}$")


def cidr(s: Column) -> Column:
    return ipv4(F.substring_index(s, "/", 1)) & F.coalesce(F.substring_index(s, "/", -1).try_cast("int") <= 32, F.lit(False))
