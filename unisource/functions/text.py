"""Names, paths and sizes as Column -> Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every white-space character of the Unicode table; Spark's trim() knows only the blank.
SPACES = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())

# Letters that have a case; a word for title-casing is a run of them.
_CASED = r"\p{IsLowercase}\p{IsUppercase}\p{Lt}"
_CASE_RUNS = f"([{_CASED}]+|[^{_CASED}]+)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim Unicode white space on both sides."""
    return F.btrim(col(c), F.lit(SPACES))


def non_empty(c: Column | str) -> Column:
    """The text, or null when it is empty."""
    return F.nullif(col(c), F.lit(""))


def display_name(name: Column | str) -> Column:
    """Underscores become blanks and each run of cased letters gets a capital."""
    spaced = F.replace(col(name), F.lit("_"), F.lit(" "))
    runs = F.regexp_extract_all(spaced, F.lit(_CASE_RUNS), F.lit(1))
    return F.when(spaced.isNotNull(), F.concat_ws("", F.transform(runs, F.initcap)))


def entity_name_from_source(name: Column | str) -> Column:
    return F.lower(F.replace(col(name), F.lit(" "), F.lit("_")))


def entity_name_from_path(path: Column | str, flatten: bool = False) -> Column:
    """Endpoint path without outer slashes; `flatten` also replaces the inner ones."""
    bare = F.btrim(col(path), F.lit("/"))
    if flatten:
        bare = F.replace(bare, F.lit("/"), F.lit("_"))
    return F.coalesce(non_empty(bare), F.lit("data"))


PAGE_MARK = "#page="


def first_page(path: Column | str) -> Column:
    """Path of the endpoint a landed page belongs to."""
    return F.regexp_replace(col(path), PAGE_MARK + "[0-9]+$", "")


def page_number(path: Column | str) -> Column:
    """Number of a landed page, from 1; a path without mark is the first."""
    return F.coalesce(F.regexp_extract(col(path), PAGE_MARK + "([0-9]+)$", 1).try_cast("bigint"), F.lit(1))


def human_size(size: Column | str) -> Column:
    """Bytes as o, Ko, Mo, Go or To with one decimal, ties rounded to even."""
    n = col(size).cast("double")
    # Java's %.1f rounds ties up, so round to even first.
    def shown(power: int, unit: str) -> Column:
        return F.format_string(f"%.1f {unit}", F.bround(n / F.lit(float(1024**power)), 1))

    return (
        F.when(n.isNull(), F.lit(None).cast("string"))
        .when(n < 1024, shown(0, "o"))
        .when(n < 1024**2, shown(1, "Ko"))
        .when(n < 1024**3, shown(2, "Mo"))
        .when(n < 1024**4, shown(3, "Go"))
        .otherwise(shown(4, "To"))
    )


def resolve_path(file_path: Column | str, uploaded_path: Column | str, base_url: Column | str) -> Column:
    """First configured location; a Windows drive or share maps onto its mount point."""
    p = col(file_path)
    slashed = F.replace(p, F.lit("\\"), F.lit("/"))
    mounted = (
        F.when(
            (F.length(p) > 2) & (F.substring(p, 2, 1) == ":"),
            F.concat(F.lit("/mnt/host/"), F.substring(slashed, 4, 1 << 30)),
        )
        .when(p.startswith("\\\\"), F.concat(F.lit("/mnt/network/"), F.substring(slashed, 3, 1 << 30)))
        .when(p.startswith("//"), F.concat(F.lit("/mnt/network/"), F.substring(p, 3, 1 << 30)))
        .otherwise(p)
    )
    return F.coalesce(
        F.when(non_empty(p).isNotNull(), mounted), non_empty(uploaded_path), non_empty(base_url), F.lit("")
    )


def starts_with_any(name: Column | str, prefixes: list[str]) -> Column:
    """Case-blind prefix test; no prefix at all means no filter."""
    if not prefixes:
        return F.lit(True)
    wanted = F.array(*[F.lit(p) for p in prefixes])
    return F.exists(wanted, lambda p: F.startswith(F.upper(col(name)), F.upper(p)))
