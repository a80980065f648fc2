"""Irrigation advisories from the root-zone deficit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import at_least, clip, col, lookup
from .soil import stress_coefficient

#: What a stage makes of the depletion share.
STAGE_SCALE = {"ini": 1.10, "dev": 1.00, "mid": 0.85, "flowering": 0.80, "reproductive": 0.80, "late": 1.05, "maturity": 1.20}
WATCH, SOON, CRITICAL_KS, CRITICAL_SHARE, EFFICIENCY = 0.40, 0.75, 0.40, 0.90, 0.6
STATUS = ("NO_IRRIGATION", "WATCH", "IRRIGATE_SOON", "IRRIGATE_NOW", "CRITICAL")
#: How much a stage suffers from a deficit.
SENSITIVITY = {"initial": 0.4, "development": 0.8, "mid": 1.2, "late": 0.7}


def codes(deficit, raw, ks, taw, soon: float = SOON, watch: float = WATCH, critical_ks: float = CRITICAL_KS) -> Column:
    """0 none to 4 critical; -1 where the deficit or RAW is missing."""
    d, r = col(deficit), col(raw)
    share = F.when(col(taw) > 0, d / F.when(col(taw) > 0, col(taw))).otherwise(F.lit(0.0))
    critical = F.coalesce(col(ks) <= critical_ks, F.lit(False)) | F.coalesce(share >= CRITICAL_SHARE, F.lit(False))
    out = F.when(d.isNull() | r.isNull(), -1).when(critical, 4).when(d >= r, 3).when(d >= soon * r, 2).when(d >= watch * r, 1).otherwise(0)
    return out.cast("tinyint")


def upland(dr, raw, ks, taw) -> Column:
    return codes(dr, raw, ks, taw)


def ponded(dr, raw, taw, stage) -> Column:
    """Alternate wetting and drying: stages near harvest need nothing once dry; a full pond needs nothing either."""
    d, r, t, s = col(dr), col(raw), col(taw), F.lower(col(stage))
    ripe = s.isin("late", "maturity", "senescence")
    return F.when(ripe & (d >= r), 0).when(d >= 0.9 * t, 4).when(d >= r, 3).when(d >= 0.6 * r, 2).when(d <= 0.05 * t, 0).otherwise(1).cast("tinyint")


def evaluate(dr, taw, p, stage, etc, ks=None, is_ponded=None, efficiency: float = EFFICIENCY) -> dict[str, Column]:
    """p_eff, raw, ks, status and its name, net and gross depth, days until RAW is reached (infinite if never)."""
    p_eff = clip(col(p) * F.coalesce(lookup(STAGE_SCALE, F.lower(col(stage))), F.lit(1.0)), 0.05, 0.95)
    raw = p_eff * col(taw)
    k = stress_coefficient(dr, taw, p_eff) if ks is None else F.coalesce(col(ks), stress_coefficient(dr, taw, p_eff))
    status = upland(dr, raw, k, taw)
    if is_ponded is not None:
        status = F.when(col(is_ponded), ponded(dr, raw, taw, stage)).otherwise(status)
    net = at_least(dr, 0.0)
    days = F.when(col(etc) > 1e-9, at_least((raw - col(dr)) / F.when(col(etc) > 1e-9, col(etc)), 0.0)).when(col(dr) < raw, float("inf")).otherwise(0.0)
    return {"p_eff": p_eff, "raw": raw, "ks": k, "status": status, "status_name": F.element_at(F.array(*map(F.lit, STATUS)), status.cast("int") + 1), "dnet": net, "dgross": net / efficiency, "days_to_trigger": days}


def server_deficit(kc, et0, rain, supply) -> Column:
    return at_least(col(kc) * col(et0) - col(rain) - col(supply), 0.0)


def server_classes(deficit, cuts=(5.0, 15.0, 30.0)) -> Column:
    return sum(((col(deficit) >= c).cast("int") for c in cuts), F.lit(0))


def from_ratio(ratio, stage) -> dict[str, Column]:
    """Advisory and stress class from the deficit as a share of RAW, weighted by the stage's sensitivity."""
    eff = col(ratio) * (0.85 + 0.25 * (lookup(SENSITIVITY, col(stage)) - 0.4))
    pick = lambda names: F.when(eff < 0.5, names[0]).when(eff < 0.85, names[1]).when(eff < 1.0, names[2]).when(eff < 1.25, names[3]).when(eff.isNotNull(), names[4])
    return {"advisory": pick(("no_irrigation", "watch", "irrigate_soon", "irrigate_now", "critical")), "stress_class": pick(("none", "mild", "moderate", "severe", "extreme"))}


def serving_status(deficit) -> dict[str, Column]:
    d = col(deficit)
    pick = lambda names: F.when(d <= 2, names[0]).when(d <= 10, names[1]).when(d <= 25, names[2]).when(d.isNotNull(), names[3])
    return {"status": pick(("adequate", "mild_deficit", "moderate_deficit", "severe_deficit")), "action": pick(("no_irrigation", "monitor", "irrigate_soon", "irrigate_now"))}


def season_stage(step, planted, length, fallow) -> Column:
    """Stage by the share of the season passed, in steps."""
    rel = (col(step) - col(planted)) / F.greatest(F.lit(1), col(length))
    return F.when(col(fallow) | (rel < 0.2), "initial").when(rel < 0.45, "development").when(rel < 0.75, "mid").otherwise("late")
