"""Folders of vendors' files as a Spark data source: fund workbooks, statements and profiles.

    spark.dataSource.register(VendorFiles)
    spark.read.format("vendor_files").options(kind="income", symbols="AAPL,MSFT").load(folder)

A file holds what one endpoint gave for one symbol, which its name ends with
(``income-AAPL.json``, ``holdings-daily-us-en-xlk.xlsx``). Each kind has a declared schema.
Files are packed into partitions by their sizes, and the option symbols chooses files before any
is opened. (Pushed filters would do so too, but Spark 4.1 keeps what one query has pushed for the
next one of the same DataFrame, a join with itself among them.) Folders may lie in any store that Arrow's file systems reach.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tallyforge.sources.readers import VENDOR_SCHEMAS, fund_holdings, workbook_cells

#: What of a file's name comes before the symbol, by kind, and the files' ending.
STEMS = {"holdings": "holdings-daily-us-en-", "income": "income-", "ratios": "ratios-", "balance": "balance-", "cash": "cash-", "profile": "profile-"}
SCHEMAS = {k: "symbol string, seq int, " + ", ".join(c for c in s.split(", ") if not c.startswith("symbol ")) for k, s in VENDOR_SCHEMAS.items()} | {
    "holdings": "symbol string, seq int, fund_name string, ticker string, weight double"
}
#: Bytes of files in one partition, and rows of one batch.
PARTITION_BYTES, BATCH_ROWS = 32 << 20, 1000


@dataclass
class Files(InputPartition):
    """Some files: (path, symbol) of each."""

    files: list[tuple[str, str]]


class VendorFiles(DataSource):
    """Options: ``path``, the folder, ``kind``, one of STEMS, and ``symbols``, which are wanted (all). Rows of a file are numbered by ``seq``."""

    @classmethod
    def name(cls) -> str:
        return "vendor_files"

    def schema(self) -> str:
        kind = self.options.get("kind")
        if kind not in SCHEMAS:
            raise ValueError(f"kind is {kind!r}, not one of {', '.join(SCHEMAS)}")
        return SCHEMAS[kind]

    def reader(self, schema: StructType) -> "VendorReader":
        return VendorReader(self.options["path"], self.options["kind"], schema, self.options.get("symbols"))


class VendorReader(DataSourceReader):
    def __init__(self, path: str, kind: str, schema: StructType, symbols: str | None = None) -> None:
        self.path, self.kind, self.schema = path, kind, schema
        self.symbols = None if symbols is None else {s.strip().upper() for s in symbols.split(",")}

    def partitions(self) -> list[Files]:
        store, folder = fs.FileSystem.from_uri(self.path)
        ending = ".xlsx" if self.kind == "holdings" else ".json"
        found = []
        for info in store.get_file_info(fs.FileSelector(folder, recursive=True)):
            if info.type == fs.FileType.File and info.base_name.startswith(STEMS[self.kind]) and info.base_name.endswith(ending):
                symbol = info.base_name.removeprefix(STEMS[self.kind]).removesuffix(ending).upper()
                if self.symbols is None or symbol in self.symbols:
                    found.append((info.path, symbol, info.size))
        parts, room = [], 0
        for path, symbol, size in sorted(found):
            if not parts or room < size:
                parts.append(Files([]))
                room = PARTITION_BYTES
            parts[-1].files.append((path, symbol))
            room -= size
        return parts or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.path)
        schema, rows = to_arrow_schema(self.schema), []
        for path, symbol in partition.files:
            with store.open_input_stream(path) as f:
                content = f.read()
            made = fund_rows(content) if self.kind == "holdings" else json_rows(content, self.schema)
            for seq, row in enumerate(made):
                rows.append(row | {"symbol": symbol, "seq": seq})
                if len(rows) == BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
        yield pa.RecordBatch.from_pylist(rows, schema)


def fund_rows(content: bytes) -> list[dict]:
    name, rows = fund_holdings(workbook_cells(content))
    return [{"fund_name": name, "ticker": t, "weight": w} for t, w in rows]


def json_rows(content: bytes, schema: StructType) -> list[dict]:
    """The objects of a JSON array, keys in any case: unknown keys are left out, missing and unfit values are null."""
    kinds = {f.name.lower(): (f.name, f.dataType.typeName()) for f in schema.fields}
    out = []
    for record in json.load(io.BytesIO(content)) or []:
        row = {}
        for key, value in record.items():
            name, kind = kinds.get(key.lower(), (None, None))
            if name and value is not None:
                row[name] = number(value) if kind == "double" else value if isinstance(value, str) else json.dumps(value)
        out.append(row)
    return out


def number(value: object) -> float | None:
    try:
        return None if isinstance(value, bool) else float(value)
    except (TypeError, ValueError):
        return None
