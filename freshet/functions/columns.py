"""Column functions of the task plane."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def human_bytes(n: Column) -> Column:
    """Bytes in steps of 1024: whole bytes, else one decimal, ties to even."""
    one = lambda x: F.bround(x, 1)
    out = F.format_string("%.1f TiB", one(n / F.lit(1024.0**4)))
    for power, unit in ((3, "GiB"), (2, "MiB"), (1, "KiB")):
        out = F.when(n < 1024 ** (power + 1), F.format_string(f"%.1f {unit}", one(n / F.lit(1024.0**power)))).otherwise(out)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(out)


def traceback_frames(text: Column) -> Column:
    """``file:line:function`` of each frame of a Python traceback, outermost first."""
    pattern = F.lit(r'File "([^"]+)", line (\d+), in (\S+)')
    return F.zip_with(F.zip_with(F.regexp_extract_all(text, pattern, 1), F.regexp_extract_all(text, pattern, 2), lambda a, b: F.concat(a, F.lit(":"), b)), F.regexp_extract_all(text, pattern, 3), lambda a, b: F.concat(a, F.lit(":"), b))


def exception_type(text: Column) -> Column:
    """The name before the first colon of the last line."""
    last = F.element_at(F.split(F.regexp_replace(text, r"\s+$", ""), "\n"), -1)
    return F.trim(F.element_at(F.split(last, ":"), 1))
