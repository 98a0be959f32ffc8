"""From a family's raw answers to the tests of schemes, with caveats: what scoring.entitlements takes as given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Answers about work and residency, benefits that qualify, and limits without recourse to public funds by (London, two children or more).
NOT_WORKING, OVER_100K, ABOVE_WAGE, ABOVE_APPRENTICE_WAGE = "not_working", "income_over_100k", "earning_above_nmw", "earning_above_apprentice_nmw"
SETTLED, NO_RECOURSE = ("british_irish_citizen", "settled_status", "pre_settled_status", "permission_to_access_public_funds"), "no_recourse_to_public_funds"
UNIVERSAL_CREDIT, OTHER_BENEFITS = "universal_credit", ("esa", "pension_credit")
INCOME_LIMITS, SAVINGS_LIMIT = {(True, True): 38600, (True, False): 34500, (False, True): 30600, (False, False): 26500}, 16000

c = F.col


def _yes(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def works(p: Column) -> Column:
    return p["status"] != NOT_WORKING


def earns(p: Column) -> Column:
    """Over the wage of the age bracket, or an apprentice of the first year over theirs."""
    return p["status"].isin(OVER_100K, ABOVE_WAGE) | ((p["status"] == ABOVE_APPRENTICE_WAGE) & p["apprentice"] & p["first_year"])


def starts_up(p: Column) -> Column:
    return p["self_employed"] & p["under_a_year"]


def family_tests(families: DataFrame) -> DataFrame:
    """families with user_works, partner_works, user_exempt, partner_exempt, earns_enough, over_100k, in_england, public_funds,
    ni_number, on_uc, low_income and caveats (codes, in order).

    Columns: user and partner (null without one): struct<status, apprentice, first_year, self_employed, under_a_year, allowance,
    residency, ni>; has_partner, areas (codes), benefits, uc_income_low, n_children, income_limit and savings_limit (what the family says
    it is under). A missing answer counts as no.
    """
    u, p, couple = c("user"), c("partner"), _yes(c("has_partner"))
    both = c("partner").isNotNull()
    user_works, partner_works = _yes(works(u)), both & _yes(works(p))
    user_exempt, partner_exempt = _yes(u["allowance"]), both & _yes(p["allowance"])
    user_earns, partner_earns, user_starts, partner_starts = _yes(earns(u)), _yes(earns(p)), _yes(starts_up(u)), _yes(starts_up(p))
    pair = couple & partner_works
    able = F.when(~couple, user_works).otherwise(user_works & (partner_works | partner_exempt) | partner_works & user_exempt)
    user_open, partner_open = _yes(u["residency"].isin(*SETTLED)), both & _yes(p["residency"].isin(*SETTLED))
    any_area = lambda prefix: _yes(F.exists("areas", lambda a: a.startswith(prefix)))
    closed = _yes(u["residency"] == NO_RECOURSE) & (~both | _yes(p["residency"] == NO_RECOURSE))
    limit = F.coalesce(*(F.when((any_area("E09") == F.lit(london)) & ((c("n_children") >= 2) == F.lit(more)), v) for (london, more), v in INCOME_LIMITS.items()))
    low, saved = _yes(c("income_limit") == limit), _yes(c("savings_limit") == SAVINGS_LIMIT)
    has = lambda b: _yes(F.array_contains("benefits", b))
    caveat = lambda when, code: F.when(when, code)
    caveats = F.array_compact(F.array(
        caveat(couple & user_works & ~partner_works & partner_exempt, "partner_carers_allowance_exemption"), caveat(couple & ~user_works & partner_works & user_exempt, "user_carers_allowance_exemption"),
        caveat(able & ~user_earns & user_starts, "user_self_employed_startup"), caveat(able & pair & ~partner_earns & partner_starts, "partner_self_employed_startup"),
        caveat((user_open != partner_open) & couple, "apply_with_public_funds_parent"), caveat(closed & ~low, "nrpf_income_above_threshold"), caveat(closed & ~saved, "nrpf_savings_above_limit"),
    ))
    return families.withColumns({
        "user_works": user_works, "partner_works": partner_works, "user_exempt": user_exempt, "partner_exempt": partner_exempt, "earns_enough": ~(user_works & ~user_earns & ~user_starts) & ~(pair & ~partner_earns & ~partner_starts),
        "over_100k": _yes(u["status"] == OVER_100K) | both & _yes(p["status"] == OVER_100K), "in_england": any_area("E"), "public_funds": user_open | partner_open, "ni_number": _yes(u["ni"]) & (~both | _yes(p["ni"])), "on_uc": has(UNIVERSAL_CREDIT),
        "low_income": has(UNIVERSAL_CREDIT) & _yes(c("uc_income_low")) | closed & low & saved | has(OTHER_BENEFITS[0]) | has(OTHER_BENEFITS[1]), "caveats": caveats,
    })
