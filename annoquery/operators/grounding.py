"""Language-grounding records: prompts of a query, bilingual expressions of regions, checks on rewritten expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalized, plural

#: Garment parts, each with its English name, Chinese name and the terms that name it.
PARTS = [
    ("hood", "帽兜", ["hood", "帽兜", "连帽"]),
    ("collar", "衣领", ["collar", "衣领", "领子"]),
    ("lapel", "翻领", ["lapel", "翻领", "驳领"]),
    ("epaulette", "肩章", ["epaulette", "肩章", "肩部装饰"]),
    ("sleeve", "袖子", ["sleeve", "袖子", "衣袖"]),
    ("pocket", "口袋", ["pocket", "口袋", "衣袋"]),
    ("neckline", "领口", ["neckline", "领口", "领口线"]),
    ("buckle", "搭扣", ["buckle", "搭扣", "扣环"]),
    ("zipper", "拉链", ["zipper", "拉链"]),
    ("applique", "贴花", ["applique", "贴花", "贴布"]),
    ("bead", "珠饰", ["bead", "珠饰", "钉珠"]),
    ("bow", "蝴蝶结", ["bow", "蝴蝶结"]),
    ("flower", "花饰", ["flower decoration", "花饰"]),
    ("fringe", "流苏边", ["fringe", "流苏边"]),
    ("ribbon", "丝带", ["ribbon", "丝带"]),
    ("rivet", "铆钉", ["rivet", "铆钉"]),
    ("ruffle", "荷叶边", ["ruffle", "荷叶边", "褶边"]),
    ("sequin", "亮片", ["sequin", "亮片"]),
    ("tassel", "穗饰", ["tassel", "穗饰", "流苏"]),
]
#: Regions, each with its prompt and the terms that name it.
REGIONS = [
    ("collar", "neckline . collar . lapel", ["领口", "衣领", "领子", "neckline", "collar"]),
    ("cuff", "cuff . sleeve cuff", ["袖口", "cuff", "sleeve cuff"]),
    ("hem", "garment hem . lower hem", ["下摆", "衣摆", "hem", "lower hem"]),
    ("pocket", "pocket", ["口袋", "衣袋", "pocket"]),
    ("shoulder", "shoulder area . epaulette", ["肩部", "肩膀", "shoulder", "shoulder area"]),
    ("waist", "waist area . waistline", ["腰部", "腰线", "waist", "waistline"]),
    ("pattern", "fabric pattern . printed pattern", ["图案", "花纹", "纹样", "pattern", "printed pattern"]),
    ("decoration", "clothing decoration . embellishment", ["装饰", "装饰物", "decoration", "embellishment"]),
]
#: Phrases of questions about the whole image.
GENERAL_QUESTIONS = ["图中有哪些服饰", "图中有什么服饰", "有哪些衣服", "这是什么服饰", "这是什么衣服", "what clothes are in", "what garments are in", "what is this garment"]
#: (label, prompt, term, priority): on equal length, a part wins over a region.
TERMS = [(label, prompt, term, 1) for label, prompt, terms in REGIONS for term in terms] + [(label, terms[0], term, 2) for label, _, terms in PARTS for term in terms]


def resolve_prompt(query: Column | str) -> Column:
    """Struct of label, prompt and term for the longest dictionary term in a query.

    Ties go to parts, then to the earlier term. Without a term the label is ``custom`` and the query its own prompt; a blank query gives null.
    """
    low = F.lower(normalized(query))
    table = [F.struct(F.lit(len(t)).alias("size"), F.lit(p).alias("priority"), F.lit(-i).alias("at"), F.lit(label).alias("label"), F.lit(prompt).alias("prompt"), F.lit(t).alias("term")) for i, (label, prompt, t, p) in enumerate(TERMS)]
    best = F.array_max(F.filter(F.array(*table), lambda t: F.contains(low, t["term"])))
    custom = F.struct(F.lit("custom").alias("label"), low.alias("prompt"), normalized(query).alias("term"))
    return F.when(low.isNull(), None).when(best.isNull(), custom).otherwise(F.struct(best["label"].alias("label"), best["prompt"].alias("prompt"), best["term"].alias("term")))


def asks_for_region(query: Column | str) -> Column:
    """Whether a query may name a region: not blank and no question about the whole image."""
    low = F.lower(normalized(query))
    return low.isNotNull() & ~F.coalesce(low.rlike("|".join(GENERAL_QUESTIONS)), F.lit(False))


def in_language(text: Column | str, language: Column | str) -> Column:
    """Chinese texts hold an ideograph, English ones none; other languages are not checked (null)."""
    text, language = F.col(text) if isinstance(text, str) else text, F.col(language) if isinstance(language, str) else language
    ideograph = text.rlike(r"[\x{3400}-\x{9fff}]")
    return F.when(language == "zh", ideograph).when(language == "en", ~ideograph)


def attribute_phrase(label: Column, attribute: Column, n: Column) -> Column:
    """English expression for parts with an attribute; null where the hint in brackets names another part."""
    value, hint = F.regexp_extract(attribute, r"^(.+?)\s*\(([^()]+)\)$", 1), F.lower(F.trim(F.regexp_extract(attribute, r"^(.+?)\s*\(([^()]+)\)$", 2)))
    target = F.when(n == 1, F.concat(F.lit("the "), label)).otherwise(F.concat(F.lit("all "), plural(label)))
    wrong = (hint.isin("neck", "neckline") & ~label.isin("neckline", "collar")) | (hint.isin("pocket", "sleeve") & (label != hint))
    narrowed = F.when(n == 1, F.concat(F.lit("the "), value, F.lit(" "), label)).otherwise(F.concat(F.lit("all "), value, F.lit(" "), plural(label)))
    return F.when(hint == "", F.concat(target, F.lit(" with "), attribute)).when(~wrong, narrowed)


def _expressions(parts: DataFrame, keys: list[str], template: Column, zh: Column, en: Column) -> DataFrame:
    """One record in either language for each group of parts that one expression names."""
    ids = F.array_sort(F.collect_list("ann_id"))  # the parts of one label in one image
    n = F.size(F.collect_list(F.struct("ann_id"))).cast("long")  # lists are sorted once there are many groups; counts alone would keep all groups in a table in memory
    groups = parts.groupBy("image_id", "label", "label_zh", *keys).agg(n.alias("n"), ids.alias("targets"))
    groups = groups.withColumn("zh", F.when(F.col("n") == 1, F.col("label_zh")).otherwise(F.concat(F.lit("所有"), "label_zh")))
    groups = groups.withColumn("en", F.when(F.col("n") == 1, F.concat(F.lit("the "), "label")).otherwise(F.concat(F.lit("all "), plural("label"))))
    both = F.explode(F.array(F.struct(F.lit("zh").alias("language"), zh.alias("query")), F.struct(F.lit("en").alias("language"), en.alias("query"))))
    rows = groups.select("image_id", "label", "n", "targets", template.alias("template"), both.alias("e")).select("*", "e.*")
    sample_id = F.concat_ws("-", F.col("image_id").cast("string"), "label", "template", "language", F.array_join(F.col("targets").cast("array<string>"), "-"))
    return rows.select(sample_id.alias("sample_id"), "image_id", "label", "language", "query", "n")


def expressions(parts: DataFrame) -> DataFrame:
    """Bilingual records for parts (image_id, ann_id, label, label_zh, garment, garment_zh): plain ones and, where a part lies in one known garment, relations."""
    plain = _expressions(parts, [], F.lit("basic"), F.concat(F.lit("这件衣服的"), "zh"), F.concat("en", F.lit(" on the garment")))
    name = F.when(F.col("garment") == "top", "top garment").otherwise(F.col("garment"))
    template = F.concat(F.lit("relation-"), "garment")
    related = _expressions(parts.where("garment is not null"), ["garment", "garment_zh"], template, F.concat(F.lit("这件"), "garment_zh", F.lit("上的"), "zh"), F.concat("en", F.lit(" on the "), name))
    return plain.union(related)


def parse_answers(response: Column | str) -> Column:
    """Distinct non-blank strings of a JSON array in a model's answer, bare or in a fence; null if there is none."""
    array = F.regexp_extract(response, r"(?s)(\[.*\])", 1)
    parsed = F.from_json(array, "array<string>")
    return F.array_distinct(F.array_compact(F.transform(parsed, lambda s: normalized(s))))


def unclean_reasons(text: Column | str, most_words: int = 24) -> Column:
    """Names of the rules that a rewritten expression breaks; an empty array for a clean one."""
    text = F.col(text) if isinstance(text, str) else text
    rules = {
        "blank": normalized(text).isNull(),
        "brackets": text.rlike(r"[()（）\[\]]"),
        "quotes": text.rlike("[\"“”「」]"),
        "repeated_word": F.lower(text).rlike(r"\b([a-z]+)\s+\1\b"),
        "too_long": F.size(F.split(F.trim(text), r"\s+")) > most_words,
        "question": text.rlike("[?？]"),
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(name == "blank")), F.lit(name)) for name, rule in rules.items()]))
