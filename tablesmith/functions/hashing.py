"""The cell hash: 60 pseudo-random bits that depend only on seed, table, column and row."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 60


@dataclass(frozen=True)
class Cells:
    """The cells of one column; ``h`` draws from them. ``xxhash64`` is fast, ``md5`` equals what SQL engines compute."""

    seed: int
    table: str
    column: str
    row: Column
    kind: str = "xxhash64"

    def text(self, salt: str = "") -> Column:
        return F.concat_ws("|", F.lit(str(self.seed)), F.lit(self.table), F.lit(self.column + salt), self.row.cast("string"))

    def h(self, salt: str = "") -> Column:
        if self.kind == "md5":
            return F.conv(F.substring(F.md5(self.text(salt)), 1, 15), 16, 10).cast("long")
        return F.xxhash64(F.lit(self.seed), F.lit(self.table), F.lit(self.column + salt), self.row).bitwiseAND(F.lit((1 << BITS) - 1))

    def digest(self, salt: str = "") -> Column:
        """32 hexadecimal digits."""
        if self.kind == "md5":
            return F.md5(self.text(salt))
        return F.concat(*[F.lpad(F.lower(F.hex(F.xxhash64(F.lit(self.seed), F.lit(self.table), F.lit(self.column + salt + part), self.row))), 16, "0") for part in ("~a", "~b")])

    def at(self, row: Column) -> Cells:
        return replace(self, row=row)
