"""Line dedup by overlapping three-line windows.

Every run of `window` consecutive lines is hashed (128 bits). A window that also starts earlier
(smaller doc_id, or the same document and an earlier line) is a repeat; all lines that some repeat
covers are removed, the others stay in order. Windows are judged on the input, not on what is left.

Defined cases: null text has no lines and stays null; '' is one empty line; documents of fewer lines
than `window` have no window and stay; rows with the same id and different texts are documents of their own, in an
order fixed by a hash of the text; rows equal in id and text are one document, so all of them keep or lose the same
lines; an empty table gives an empty result. Columns other than the id and text pass through untouched, but for such
as are named like the counts, which these replace.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import brought_back, delete, set_aside, two_hashes, written

PLACE = ("_id", "_x", "_y", "at")


def covered_lines(docs: DataFrame, window: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _x, _y, _covered), a written table: numbers of the lines that repeated windows cover, for documents (id and
    128 bits of hash of the text) that have any."""
    x, y = two_hashes(text_col)
    lines = docs.select(F.col(id_col).alias("_id"), x.alias("_x"), y.alias("_y"), F.split(text_col, "\n", -1).alias("lines")).where(F.size("lines") >= window)
    starts = F.sequence(F.lit(0), F.size("lines") - window)
    key = lambda i: F.struct(*(h.alias(n) for h, n in zip(two_hashes(*(F.get("lines", i + k) for k in range(window))), ("a", "b"))))
    windows = lines.select("_id", "_x", "_y", F.posexplode(F.transform(starts, key)).alias("at", "w")).select(*PLACE, "w.a", "w.b")
    # Both joins are merge joins at every size: what repeats grows with the corpus, and a merge can split a hot key.
    # Only hashes of windows travel; the first place of each repeated one is found with map-side partial sums. It is
    # written, so that the join may split a window that very many documents share.
    first = written(windows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*PLACE)).alias("first")).where("n > 1").drop("n"), "first")
    later = windows.join(first.hint("merge"), ["a", "b"]).where(~F.struct(*PLACE).eqNullSafe(F.col("first")))
    merged = F.array_distinct(F.flatten(F.transform(F.collect_set("at"), lambda s: F.sequence(s, s + (window - 1)))))
    out = written(later.groupBy("_id", "_x", "_y").agg(merged.alias("_covered")), "covered")
    delete(first)
    return out


def dedup_lines(docs: DataFrame, window: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text's repeated lines removed, plus n_lines and n_removed."""
    # Lines are split below the join, so that the gather over kept positions reads a computed column.
    x, y = two_hashes(text_col)
    split = set_aside(docs, id_col, text_col).withColumns({"_lines": F.split(text_col, "\n", -1), "_hx": x, "_hy": y}).drop(text_col)
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_hx") == F.col("_x")) & (F.col("_hy") == F.col("_y"))
    out = split.join(covered_lines(docs, window, id_col, text_col).hint("merge"), same, "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_covered")
    count = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("long")
    text = F.when(F.col("_covered").isNull(), F.array_join("_lines", "\n")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("_lines", i)), "\n"))
    out = out.withColumns({text_col: text, "n_lines": count("_lines"), "n_removed": count("_covered")})
    return brought_back(out, docs.columns, ["n_lines", "n_removed"])
