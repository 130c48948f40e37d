"""Filters of files, as conditions on path, length and content. Those on path and length do not read the content."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.plans.column import java_regex

#: Fixed value: a header starts the file and is closed by its own line.
HEADER = r"(?s)^---\n(.*?)\n---\n"


class FilterError(ValueError):
    """No such filter, or no parameter where it needs one."""


def steps() -> Column:
    return F.split("path", "/")


def extension(ext: str) -> Column:
    """The extension of the file's name, point included; the empty string for none."""
    return F.regexp_extract("path", r"(\.[^./]*)$", 1) == ext


def max_size(n: str | int) -> Column:
    return F.col("length") <= int(n)


def include_name(names: str) -> Column:
    return F.element_at(steps(), -1).isin(names.split(","))


def exclude_name(names: str) -> Column:
    return ~include_name(names)


def exclude_parent(folder: str) -> Column:
    """No step of the path has this name."""
    return ~F.array_contains(steps(), folder)


def include_regex(pattern: str) -> Column:
    return F.col("path").rlike(java_regex(pattern))


def exclude_regex(pattern: str) -> Column:
    return ~include_regex(pattern)


def yaml_header() -> Column:
    return F.col("content").rlike(HEADER)


FILTERS: dict[str, Callable[..., Column]] = {
    "Ext": extension, "Extension": extension, "MaxSize": max_size, "MaxFilesize": max_size,
    "ExcludeName": exclude_name, "ExcludeFilename": exclude_name, "IncludeName": include_name, "IncludeFilename": include_name,
    "ExcludeParent": exclude_parent, "IncludeRegex": include_regex, "ExcludeRegex": exclude_regex, "YAMLHeader": yaml_header,
}
#: What applies if nothing is said.
DEFAULTS = ("Ext_.md", "MaxSize_204800", "ExcludeParent_templates", "YAMLHeader")


#: A filter: its text, a condition on path, length and content, or a function of them.
Filter = str | Column | Callable[[str, int, str | None], bool]


def register(name: str, make: Callable[[str], Column]) -> None:
    """Make `Name_parameter` a filter in texts and on the command line."""
    if "_" in name:
        raise FilterError(f"{name!r} has the mark that ends a name")
    FILTERS[name] = make


def from_function(keep: Callable[[str, int, str | None], bool]) -> Column:
    """A condition by a Python function of path, length and content; slower than a column expression."""

    @F.udf("boolean", useArrow=True)
    def call(path: str, length: int, content: str | None) -> bool:
        return bool(keep(path, length, content))

    return call("path", "length", "content")


def parse_filter(spec: Filter) -> Column:
    """`Name_parameter`, or the name of a filter without parameter; conditions and functions stand for themselves."""
    if isinstance(spec, Column):
        return spec
    if not isinstance(spec, str):
        return from_function(spec)
    name, mark, value = spec.partition("_")
    if name not in FILTERS:
        raise FilterError(f"no filter {name!r}")
    if name == "YAMLHeader":
        return yaml_header()
    if not mark:
        raise FilterError(f"filter {name} needs a parameter")
    try:
        return FILTERS[name](value)
    except ValueError as e:
        raise FilterError(f"filter {spec!r}: {e}") from None


def condition(specs: tuple[Filter, ...] | list[Filter] = DEFAULTS) -> Column:
    """What a file must meet to be accepted by all filters."""
    return reduce(lambda a, b: a & b, map(parse_filter, specs), F.lit(True))


def accept(files: DataFrame, specs: tuple[Filter, ...] | list[Filter] = DEFAULTS) -> DataFrame:
    """The files all filters accept."""
    return files.where(condition(specs))
