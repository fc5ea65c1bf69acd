"""Labels, file names and keys made of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings that offline augmentation and splitting leave on names.
AUGMENTED = r"(?i)_(\d+deg|rot\d+|fliplr|flipud|flip)$"
SPLIT_ENDINGS = r"(?i)(_(valid|test|train))+$"
ALL_SPLIT_ENDINGS = r"(?i)(_(valid|val|test|train))+$"
UUID = r"(?i)([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})"


def normalised(name: Column) -> Column:
    """Lower-cased letters and digits of ASCII only."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def split_class(name: Column) -> Column:
    """struct<crop, rest>: what is before and after the first ___; no crop without one."""
    at = F.instr(name, "___")
    clean = lambda c: F.trim(F.regexp_replace(c, "_", " "))
    return F.struct(
        F.when(at > 0, clean(F.substring(name, F.lit(1), at - 1))).otherwise("").alias("crop"),
        clean(F.when(at > 0, F.substring(name, at + 3, F.length(name))).otherwise(name)).alias("rest"),
    )


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(name: Column) -> Column:
    """A file's name without its last ending."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def label_from_file(name: Column) -> Column:
    """cotton_blight_2.jpg: cotton_blight. Number at the end, then marks around, then case."""
    return F.lower(F.regexp_replace(F.regexp_replace(stem(name), r"[_\-\s]*\d+$", ""), r"^[_\- ]+|[_\- ]+$", ""))


def label_of_photo(name: Column) -> Column:
    """cotton_blight_2.jpg: cotton_blight. Only what follows the last underscore goes, if it is a number and something stands before it; case is kept."""
    plain = stem(name)
    return F.when(plain.rlike(r"^(?s:.)+_\d+$"), F.regexp_replace(plain, r"_\d+$", "")).otherwise(plain)


def family_of_photo(name: Column) -> Column:
    """The source photo: without augmentation and collision endings, before the first run of
    three or more underscores, the UUID in it if there is one, lower-cased."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(stem(name)), AUGMENTED, ""), r"__\d+$", "")
    return _family(plain)


def family_of_file(name: Column) -> Column:
    """The same, endings kept."""
    return _family(F.trim(stem(name)))


def _family(text: Column) -> Column:
    head = F.split(text, "_{3,}", 2)[0]
    uuid = F.regexp_extract(head, UUID, 1)
    return F.lower(F.when(uuid != "", uuid).otherwise(head))


def family_of_leaf(name: Column) -> Column:
    """Before the first ___, case kept."""
    return F.split(stem(name), "___", 2)[0]


def parsed_name(name: Column) -> Column:
    """struct<family, label, identifier, aug, copy> of a file name family___label id_aug."""
    s = stem(name)
    has = F.instr(s, "___") > 0
    body = F.when(has, F.substring(s, F.instr(s, "___") + 3, F.length(s))).otherwise(s)
    aug = F.when(F.instr(body, "_") > 0, F.element_at(F.split(body, "_"), -1)).otherwise("")
    head = F.when(F.instr(body, "_") > 0, F.regexp_replace(body, "_[^_]*$", "")).otherwise(body)
    copied = head.rlike(r"(?i)\s*copy\s*\d*")
    number = F.regexp_extract(head, r"(?i)\s*copy\s*(\d*)", 1)
    rest = F.regexp_replace(head, r"(?i)\s*copy\s*(\d*)", "")
    digits = F.regexp_extract_all(rest, F.lit(r"(\d+)"), F.lit(1))
    return F.struct(
        F.when(has, F.substring(s, F.lit(1), F.instr(s, "___") - 1)).otherwise(s).alias("family"),
        F.lower(F.trim(rest)).alias("label"),
        F.when(F.size(digits) > 0, F.element_at(digits, -1)).try_cast("long").alias("identifier"),
        F.lower(aug).alias("aug"),
        F.when(copied & (number != ""), number).when(copied, "2").otherwise("1").alias("copy"),
    )


def plain_crop(crop: Column) -> Column:
    """Without what follows a bracket or comma."""
    before = F.regexp_replace(F.split(F.trim(crop), r"\(", 2)[0], "_+$", "")
    return F.trim(F.split(F.trim(F.when(F.instr(crop, "(") > 0, before).otherwise(crop)), ",", 2)[0])


def merged_class(name: Column) -> Column:
    """crop___healthy with a plain crop for healthy classes, others as they are."""
    n = F.trim(name)
    parts = F.split(n, "___", 2)
    healthy = (F.size(parts) > 1) & F.lower(F.get(parts, F.lit(1))).contains("healthy")
    return F.when(healthy, F.concat(plain_crop(parts[0]), F.lit("___healthy"))).otherwise(n)


def without_split_endings(name: Column, endings: str = SPLIT_ENDINGS) -> Column:
    return F.regexp_replace(F.trim(name), endings, "")


def snake(name: Column) -> Column:
    """Words joined by single underscores, lower-cased."""
    return F.lower(F.array_join(F.filter(F.split(F.regexp_replace(name, "[-_]", " "), r"\s+"), lambda w: w != ""), "_"))


def capital_snake(name: Column) -> Column:
    """Words at hyphens and spaces, joined by underscores, lower-cased but for a first capital."""
    s = F.lower(F.array_join(F.filter(F.split(F.regexp_replace(name, "-", " "), r"\s+"), lambda w: w != ""), "_"))
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, F.lit(2), F.length(s)))


def count_key(name: Column) -> Column:
    """Key under which spellings of one class count once."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), ALL_SPLIT_ENDINGS, ""), r"[^\p{L}\p{N}]", "")


def naming_pattern(name: Column) -> Column:
    """Aggregate over the class names of a dataset: how it names its classes."""
    plain = F.trim(F.regexp_replace(F.trim(name), ALL_SPLIT_ENDINGS, ""))
    digits, parted = plain.rlike(r"^\d+$"), F.instr(plain, "___") > 0
    return F.when(F.count(name) == 0, "unknown").when(F.bool_and(digits), "numeric_class_ids").when(F.bool_and(parted), "crop___disease").when(F.bool_or(parted), "mixed (crop___disease + other)").otherwise("plain_label_names")


def group_by_prefix(name: Column, groups: list[str]) -> Column:
    """The first listed group that the name starts with, else other."""
    out = F.lit("other")
    for g in reversed(groups):
        out = F.when(name.startswith(g), F.lit(g)).otherwise(out)
    return out


def group_by_alias(name: Column, aliases: dict[str, str], normal: bool = False) -> Column:
    """What is before the first ___ through an alias map; with normal, both sides normalised."""
    head = F.split(name, "___", 2)[0]
    key = normalised(head) if normal else head
    out = key if normal else head
    for k, v in sorted(aliases.items()):
        out = F.when(key == (k.lower() if normal else k), F.lit(v)).otherwise(out)
    return out


def source_tag(path: Column, tags: dict[str, str]) -> Column:
    """Name of the first tag whose text is in the lower-cased path, else other."""
    out = F.lit("other")
    for part, tag in reversed(list(tags.items())):
        out = F.when(F.lower(path).contains(part), F.lit(tag)).otherwise(out)
    return out


def is_healthy(name: Column, strict: bool = False) -> Column:
    return name.endswith("___healthy") if strict else F.lower(name).contains("healthy")


def confusion_kind(crop_true: Column, crop_pred: Column) -> Column:
    return F.when(crop_true == crop_pred, "same crop").otherwise("wrong crop")


def read_boolean(text: Column) -> Column:
    """1/0, yes/no and true/false in any case; else null."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("1", "yes", "true"), True).when(t.isin("0", "no", "false"), False)
