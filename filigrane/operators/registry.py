"""A declarative registry of a report: named sources, and the sheets that are cut from them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigrane.operators.report import sheet_name
from filigrane.sources.tables import write_bundle


@dataclass(frozen=True)
class Sheet:
    """A sheet of a book: rows of a source, perhaps under a condition, in these columns; index: columns put first."""

    book: str
    name: str
    source: str
    where: str | None = None
    columns: tuple[str, ...] = ()
    index: tuple[str, ...] = ()


@dataclass
class Registry:
    sources: dict[str, DataFrame] = field(default_factory=dict)
    sheets: list[Sheet] = field(default_factory=list)

    def add_source(self, name: str, frame: DataFrame) -> None:
        if name in self.sources:
            raise ValueError(f"source {name} is registered already")
        self.sources[name] = frame

    def add_sheet(self, sheet: Sheet) -> None:
        if sheet.source not in self.sources:
            raise ValueError(f"sheet {sheet.name} names the unknown source {sheet.source}")
        self.sheets.append(sheet)

    def frame(self, sheet: Sheet) -> DataFrame:
        rows = self.sources[sheet.source]
        rows = rows.where(sheet.where) if sheet.where else rows
        columns = sheet.columns or tuple(rows.columns)
        return rows.select(*sheet.index, *[c for c in columns if c not in sheet.index])

    def summary(self) -> DataFrame:
        """(book, sheet, n) of every sheet that has rows."""
        parts = [self.frame(s).agg(F.count("*").alias("n")).select(F.lit(s.book).alias("book"), sheet_name(F.lit(s.name)).alias("sheet"), "n") for s in self.sheets]
        if not parts:
            raise ValueError("the registry has no sheet")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.where("n > 0")

    def write(self, folder: str) -> list[str]:
        """Every sheet with rows as a table below its book's folder; the names written."""
        books: dict[str, dict[str, DataFrame]] = {}
        for s in self.sheets:
            frame = self.frame(s)
            if not frame.isEmpty():
                books.setdefault(s.book, {})[s.name] = frame
        for book, bundle in books.items():
            write_bundle(bundle, f"{folder}/{book}")
        return [f"{book}/{name}" for book, bundle in books.items() for name in bundle]
