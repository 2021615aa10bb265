"""Column expressions for similarity, decay and intent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Categories, decay, boost, hints, weights and patterns of the
# retrieval model.
FAILURE_CATEGORIES = ("失敗模式", "failure-modes", "failures")
DECISION_CATEGORIES = ("架構決策", "decisions", "adr")
BASE_LAMBDA, FLOOR = 0.003, 0.5
FAILURE_BOOST = 1.5
NAME_HINTS = ("fail", "error", "timeout", "bug", "失敗", "錯誤")
WEIGHTS = {"location": (0.7, 0.3), "concept": (0.3, 0.7), "relation": (0.4, 0.6), "failure": (0.3, 0.7), "default": (0.4, 0.6)}
PATTERNS: dict[str, tuple[str, ...]] = {
    "location": ("在哪", "哪個檔案", "路徑", "哪裡定義", "哪個.{0,5}class", "定義在", "哪個模組", "哪裡"),
    "concept": ("是什麼", "解釋", "原理", "設計", "為什麼", "怎麼運作", "什麼意思", "定義"),
    "relation": ("關係", "連結", "影響", "相關", "跟.{0,10}有何", "和.{0,10}的關係", "怎麼互動"),
    "failure": ("錯誤", "出錯", "失敗", "修復", "Exception", "exception", "bug", "error", "問題", "怎麼解決"),
}
MARKERS = ("跟.{1,15}的", "和.{1,15}的", r"vs\.?", "或者", "，.{1,20}，", ".+,.+,.+")


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles."""
    pairs = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; null where a side is all zero."""
    size = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(size > 0, dot(a, b) / size)


def decay_factor(age_days: Column, lam: Column, floor: float = FLOOR) -> Column:
    return F.lit(floor) + F.lit(1 - floor) * F.exp(-lam * F.greatest(F.lit(0.0), age_days))


def lambda_for(concept: Column, category: Column, base: float = BASE_LAMBDA, ratios: dict[str, float] | None = None, evergreen: tuple[str, ...] = ()) -> Column:
    """Decay per day; lessons, decisions and evergreen pages do not decay
    unless `ratios` says so for their category."""
    known = {c: 0.0 for c in (*FAILURE_CATEGORIES, *DECISION_CATEGORIES)} | (ratios or {})
    ratio = F.lit(1.0)
    for name, value in known.items():
        ratio = F.when(category == name, float(value)).otherwise(ratio)
    out = F.lit(base) * ratio
    return F.when(concept.isin(*evergreen), 0.0).otherwise(out) if evergreen else out


def age_days(changed: Column, now: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(changed.cast("timestamp"))) / F.lit(8.64e10)


def votes(text: Column, patterns: tuple[str, ...]) -> Column:
    total = F.lit(0)
    for p in patterns:
        total = total + F.coalesce(text.rlike("(?iu)" + p).cast("int"), F.lit(0))
    return total


def intent(text: Column, custom: dict[str, tuple[str, ...]] | None = None) -> tuple[Column, Column]:
    """Name and confidence of the intent with most matching patterns, earlier
    names first on ties; default and 0 without a match."""
    patterns = PATTERNS | (custom or {})
    counts = {name: votes(text, tuple(p)) for name, p in patterns.items()}
    best = F.greatest(*counts.values()) if len(counts) > 1 else next(iter(counts.values()))
    name = F.when(best == 0, "default")
    for key, count in counts.items():
        name = name.when(count == best, key)
    return name, F.least(best / 2, F.lit(1.0))


def needs_expansion(top_score: Column, text: Column) -> Column:
    return (F.coalesce(top_score, F.lit(0.0)) < 0.5) | (votes(text, MARKERS) > 0)


def failure_boost(name: Column, category: Column, tags: Column, categories: tuple[str, ...] = FAILURE_CATEGORIES) -> Column:
    """1.5 for pages about failures by category, tag or name; else 1."""
    hinted = F.lit(False)
    for hint in NAME_HINTS:
        hinted = hinted | F.lower(name).contains(hint)
    tagged = F.exists(F.coalesce(tags, F.array().cast("array<string>")), lambda t: t.isin(*categories))
    return F.when(F.coalesce(category.isin(*categories), F.lit(False)) | tagged | hinted, FAILURE_BOOST).otherwise(1.0)
