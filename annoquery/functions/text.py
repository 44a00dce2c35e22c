"""Text and number helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(text: Column | str) -> Column:
    """White space (of any script) collapsed to single spaces and trimmed; null where nothing is left."""
    out = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(out != "", out)


def plural(noun: Column | str) -> Column:
    """English plural: consonant + y gives ies, sibilants give es, else s."""
    noun = F.col(noun) if isinstance(noun, str) else noun
    stem = F.regexp_replace(noun, "y$", "ies")
    return F.when(noun.rlike("[^aeiou]y$"), stem).when(noun.rlike("(s|x|z|ch|sh)$"), F.concat(noun, F.lit("es"))).otherwise(F.concat(noun, F.lit("s")))


# Terms that name a direction, for constraints of a query and for the modifier of an expression.
DIRECTIONS = {
    "left": ["左边", "左侧", "画面左", "left", "leftmost"],
    "right": ["右边", "右侧", "画面右", "right", "rightmost"],
    "upper": ["最上面", "上方", "顶部", "upper", "topmost", "at the top"],
    "lower": ["最下面", "下面的", "下方", "底部", "lower", "bottommost"],
}
MODIFIERS = {"left": ["左侧", "左边", "左方", "left"], "right": ["右侧", "右边", "右方", "right"], "upper": ["上方", "上部", "上边", "upper"], "lower": ["下方", "下部", "下边", "lower"]}


def _names(text: Column, terms: list[str], edge: str = "(?<![a-z]){}(?![a-z])") -> Column:
    """Whether a text has one of the terms: English ones between edges, Chinese ones anywhere."""
    return text.rlike("|".join(edge.format(t) if t.isascii() else t for t in terms))


def directions(query: Column | str) -> Column:
    """Struct of ``horizontal`` and ``vertical``: the direction a query names on each axis, null if none or both; null for blank queries."""
    low = F.lower(normalized(query))
    one = lambda a, b: F.when(_names(low, DIRECTIONS[a]) & ~_names(low, DIRECTIONS[b]), a).when(_names(low, DIRECTIONS[b]) & ~_names(low, DIRECTIONS[a]), b)
    return F.when(low.isNotNull(), F.struct(one("left", "right").alias("horizontal"), one("upper", "lower").alias("vertical")))


def spatial_modifier(query: Column | str) -> Column:
    """The one modifier an expression names, English ones as whole words; null if none or several."""
    low = F.lower(normalized(query))
    named = F.array_compact(F.array(*[F.when(_names(low, terms, r"(?U)\b{}\b"), F.lit(name)) for name, terms in MODIFIERS.items()]))
    return F.when(F.size(named) == 1, F.get(named, F.lit(0)))


def fingerprint(*columns: Column | str) -> Column:
    """SHA-256 of a record as compact JSON with its fields, and those of structs and arrays inside, in name order; missing fields are null."""
    return F.sha2(_canonical(F.struct(*columns)), 256)


def _canonical(record: Column) -> Column:
    """Compact JSON with the keys of every object in order: through a variant, whose objects keep their fields by name."""
    return F.to_json(F.to_variant_object(record))


def calibrated(score: Column, scale: float, bias: float) -> Column:
    """Sigmoid of scale * score + bias, clipped at 80 on either side."""
    return 1 / (1 + F.exp(-F.greatest(F.lit(-80.0), F.least(F.lit(80.0), scale * score + bias))))


def paraphrase_tier(weak: Column, modifiers: Column) -> Column:
    """0 to 3, weak labels with several modifiers first."""
    rich = modifiers >= 2
    return F.when(weak & rich, 0).when(weak, 1).when(rich, 2).otherwise(3)


def loss_weight(fraction: Column, weak: Column) -> Column:
    """Twice for targets under one percent of the image, half more for weak labels, three at most."""
    return F.least(F.lit(3.0), F.when(fraction < 0.01, 2.0).otherwise(1.0) * F.when(weak, 1.5).otherwise(1.0))


def stratum(label: Column | str, language: Column | str, dimensions: Column | str) -> Column:
    """label/language/dimensions, sorted and joined by +, ``basic`` where there is no other."""
    rest = F.array_join(F.array_sort(F.array_remove(dimensions, "basic")), "+")
    return F.concat_ws("/", label, language, F.when(rest == "", "basic").otherwise(rest))


def stable_rank(seed: str, key: Column | str) -> Column:
    """Hex digest that orders rows in a seeded, reproducible way."""
    key = F.col(key) if isinstance(key, str) else key
    return F.sha2(F.concat(F.lit(seed), F.char(F.lit(0)), key.cast("string")), 256)


def percent(part: Column, whole: Column, scale: int = 6) -> Column:
    """100 * part / whole, null if the whole is 0."""
    return F.round(100 * F.try_divide(part, whole), scale)
