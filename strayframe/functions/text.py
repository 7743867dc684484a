"""Labels, concepts and prompts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY_PROMPT = "nothing in particular"


def clean_labels(items: Column, most_words: int = 5, most: int = 20) -> Column:
    """Lower-case labels of [a-z0-9 -], first seen order, distinct, short ones only."""
    tidy = F.transform(items, lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), "_", " "), r"[^a-z0-9 \-]", "")))
    kept = F.filter(tidy, lambda x: (x != "") & (F.size(F.split(x, r"\s+")) <= most_words))
    return F.slice(F.array_distinct(kept), 1, most)


def label_list(text: Column) -> Column:
    return clean_labels(F.split(text, ","))


JUDGE = "objects array<string>, unusual_objects array<string>"


def judge(text: Column) -> tuple[Column, Column]:
    """(labels, score from 0 to 1) of an answer that holds one JSON object; broken JSON has no labels and a null score, and
    so has a score that is no number (a quoted number is none; true and false count as 1 and 0)."""
    answer = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    found, none = F.from_json(answer, JUDGE), F.array().cast("array<string>")
    labels = clean_labels(F.concat(F.coalesce(found["objects"], none), F.coalesce(found["unusual_objects"], none)))
    number = F.from_json(answer, "anomaly_score double")["anomaly_score"]
    truth = F.from_json(answer, "anomaly_score boolean")["anomaly_score"].cast("double")
    return labels, F.coalesce(F.when(~F.isnan(number), number), truth) / 10


def concept(obj: Column, predicate: Column) -> Column:
    return F.concat_ws(" ", obj, predicate)


def described(concepts: Column) -> Column:
    """A prompt's items: sorted distinct concepts, each with "a"."""
    items = F.transform(F.array_sort(F.array_distinct(concepts)), lambda c: F.concat(F.lit("a "), c))
    return F.when(F.size(items) > 0, F.array_join(items, ", ")).otherwise(EMPTY_PROMPT)


def with_article(label: Column, bare: tuple[str, ...] = ()) -> Column:
    """a / an by the first letter, unless the first word takes none."""
    plain = F.split(label, " ")[0].isin(*bare) if bare else F.lit(False)
    return F.when(plain, label).when(F.lower(F.substring(label, 1, 1)).isin("a", "e", "i", "o", "u"), F.concat(F.lit("an "), label)).otherwise(F.concat(F.lit("a "), label))


def sentence(labels: Column, bare: tuple[str, ...] = ("mountains", "trees", "buildings")) -> Column:
    """I see a, b and c."""
    items = F.transform(labels, lambda x: with_article(x, bare))
    n = F.size(items)
    head = F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(1))), ", ")
    return F.concat(F.lit("I see "), F.when(n > 1, F.concat(head, F.lit(" and "), F.element_at(items, -1))).otherwise(head), F.lit("."))


def query_text(form: Column, phrasing: str, mass: tuple[str, ...] = ("water", "grass", "smoke")) -> Column:
    """Phrasing with {} for the form; forms in "photo of" phrasings take an article unless they are mass nouns."""
    before, after = phrasing.split("{}")
    named = F.when(form.isin(*mass), form).otherwise(with_article(form)) if "photo of" in phrasing else form
    return F.concat(F.lit(before), named, F.lit(after))


def by_prefix(name: Column, exact: dict[str, str], prefixes: dict[str, str], default: Column) -> Column:
    """Exact names first, then the first prefix that fits, then the default."""
    out = default
    for start, value in reversed(prefixes.items()):
        out = F.when(name.startswith(start), value).otherwise(out)
    for key, value in exact.items():
        out = F.when(name == key, value).otherwise(out)
    return out


def first_fragment(name: Column, rules: list[tuple[str, str]]) -> Column:
    """The value of the first rule whose fragment the lower-case name holds."""
    out = F.lit(None).cast("string")
    for fragment, value in reversed(rules):
        out = F.when(F.lower(name).contains(fragment), value).otherwise(out)
    return out


def seeds(text: Column) -> Column:
    """"1-3,7" as [1, 2, 3, 7]; empty parts count for nothing."""
    parts = F.transform(F.filter(F.split(text, ","), lambda p: F.trim(p) != ""), lambda p: F.sequence(F.trim(F.split(p, "-")[0]).cast("int"), F.trim(F.element_at(F.split(p, "-"), -1)).cast("int")))
    return F.flatten(parts)


def before_first(text: Column, mark: str) -> Column:
    return F.substring_index(text, mark, 1)


def after_last(text: Column, mark: str) -> Column:
    return F.substring_index(text, mark, -1)


def run_name(kind: Column, seed: Column) -> Column:
    return F.format_string("%s_%02d", kind, seed)
