"""Loans, deposits and rents as column arithmetic; amounts in units of 10,000."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tax on interest, and the most of a deposit that is lent.
INTEREST_TAX = 0.154
DEPOSIT_LTV = 0.8


def monthly_payment(principal: Column, annual_percent: Column, years: int = 30) -> Column:
    """Level payment of a loan; without interest, equal parts."""
    rate, n = annual_percent / 1200, years * 12
    grown = F.pow(1 + rate, F.lit(n))
    return F.when(annual_percent == 0, principal / n).otherwise(principal * rate * grown / (grown - 1))


def conversion_rate(jeonse: Column, deposit: Column, rent: Column) -> Column:
    """Yearly percent at which a deposit's difference turns into rent; null unless jeonse exceeds the deposit."""
    return F.when(jeonse > deposit, rent * 1200 / (jeonse - deposit))


def monthly_cost(deposit: Column, rent: Column, cash: Column, loan_percent: Column, deposit_percent: Column) -> Column:
    """Rent, plus interest on what cash does not cover, less the taxed yield of cash that is left over."""
    loan = F.least(F.greatest(deposit - cash, F.lit(0)), deposit * DEPOSIT_LTV)
    left = F.greatest(cash - deposit, F.lit(0))
    return rent + loan * loan_percent / 1200 - left * deposit_percent * (1 - INTEREST_TAX) / 1200


# Loan caps by price (10,000 won), loan shares, tax relief of a first purchase, brokerage by price.
LOAN_CAPS = ((150_000, 60_000), (250_000, 40_000), (None, 20_000))
LTV, LTV_FIRST = 40, 70
RELIEF_UP_TO, RELIEF = 120_000, 200
BROKERAGE = ((5_000, 0.6, 25), (20_000, 0.5, 80), (90_000, 0.4, None), (120_000, 0.5, None), (150_000, 0.6, None), (None, 0.7, None))


def _half_up(x: Column, scale: int) -> Column:
    return F.floor(x * scale + 0.5) / scale


def loan_cap(price: Column) -> Column:
    """The most that is lent on a home of this price; a bound belongs to the step below it."""
    (a, low), (b, mid), (_, high) = LOAN_CAPS
    return F.when(price <= a, low).when(price <= b, mid).otherwise(high)


def acquisition_rate(price: Column) -> Column:
    """Percent: 1 up to 600 million, 3 above 900 million, a line between, to two places."""
    return F.when(price <= 60_000, 1.0).when(price > 90_000, 3.0).otherwise(_half_up((price / 30_000 * 2 - 3) / 100, 10_000) * 100)


def brokerage(price: Column) -> Column:
    """The most that a broker may ask of one side."""
    out = None
    for below, rate, cap in BROKERAGE:
        fee = price * rate / 100
        fee = fee if cap is None else F.least(fee, F.lit(float(cap)))
        out = (F if out is None else out).when(price < below, fee) if below else out.otherwise(fee)
    return out


def purchase_costs(price: Column, large: Column) -> Column:
    """What a first home costs beside its price: tax, a tenth of it for education, 0.2 % on large homes, brokerage."""
    rate = acquisition_rate(price)
    return price * rate / 100 + price * _half_up(rate * 0.1, 10_000) / 100 + F.when(large, price * 0.2 / 100).otherwise(0.0) + brokerage(price)


def loan_limit(price: Column, first: bool = False) -> Column:
    """The lesser of the share that is lent and the cap."""
    return F.least(price * (LTV_FIRST if first else LTV) / 100, loan_cap(price))


def first_relief(price: Column) -> Column:
    """Tax that a first purchase is let off."""
    return F.when(price <= RELIEF_UP_TO, F.least(F.lit(float(RELIEF)), price * acquisition_rate(price) / 100)).otherwise(0.0)


def least_cash(price: Column, large: Column, first: bool = False) -> Column:
    """Own money that a purchase needs at least."""
    relief = first_relief(price) if first else F.lit(0.0)
    return price - loan_limit(price, first) + purchase_costs(price, large) - relief


def short_of(deposit: Column, cash: Column) -> Column:
    """What cash and the largest loan leave open of a deposit; 0 where it can be paid."""
    return F.greatest(F.lit(0.0), deposit - cash - deposit * DEPOSIT_LTV)


def converted_cost(deposit: Column, rent: Column, loan_percent: Column, deposit_percent: Column) -> Column:
    """Monthly cost with a fifth of the deposit in own money, whose taxed yield is what it could have earned."""
    own = deposit * (1 - DEPOSIT_LTV)
    return F.when((deposit > 0) & (rent >= 0), rent + (deposit - own) * loan_percent / 1200 + own * deposit_percent * (1 - INTEREST_TAX) / 1200)


def cheaper_side(rate: Column, loan_percent: Column, even: float = 0.3) -> Column:
    """jeonse where the conversion rate exceeds the loan's by more than `even` points, wolse the other way, else even."""
    gap = _half_up(rate - loan_percent, 100)
    return F.when(gap > even, "jeonse").when(gap < -even, "wolse").when(gap.isNotNull(), "even")


def legal_conversion(base: Column, most: float = 10.0, above: float = 2.0) -> Column:
    """The most that a deposit may be converted at: the base rate and two points, ten at most."""
    return F.least(F.lit(most), base + above)


def side_thousands(deposit: Column, rent: Column, cash: Column, loan_bp: Column, deposit_bp: Column) -> Column:
    """Monthly cost of an offer in whole thousands: interest of the loan, rent, and the yield that own money forgoes.
    Rates are whole basis points, so that no half is decided by noise; null if the deposit cannot be paid."""
    own = F.least(cash, deposit)
    short = F.greatest(F.lit(0.0), F.floor(deposit - own - deposit * DEPOSIT_LTV + 0.5))
    interest = F.floor((deposit - own) * loan_bp / 12_000 + 0.5)
    forgone = F.floor(own * deposit_bp * round((1 - INTEREST_TAX) * 1000) / 12_000_000 + 0.5)
    return F.when(short == 0, interest + F.floor(rent * 10 + 0.5) + forgone)
