"""Reading a dump: many small files in a folder, packed once into one table of texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SERVICE_FOLDER = ".codeloom"
FILES = "path string, size long, mtime timestamp, content binary"


def read_files(spark: SparkSession, root: str, glob: str | None = None, paths: list[str] | None = None) -> DataFrame:
    """``path`` (below ``root``), ``size``, ``mtime``, ``content``; listing alone does not open files, as content is pruned. Only the given ``paths`` below ``root``, where there are any."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    found = (reader.option("pathGlobFilter", glob) if glob else reader).load([f"{root.rstrip('/')}/{p}" for p in paths] if paths else root)
    base = root.rstrip("/").split(":")[-1].lstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", ""), f"^{base}/", "")
    named = found.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")
    return named.where(~F.col("path").startswith(f"{SERVICE_FOLDER}/"))


def in_memory(spark: SparkSession, files: dict[str, str | bytes]) -> DataFrame:
    """The same columns from a dict of path to content."""
    rows = [(p, len(c), None, c) for p, c in ((p, c.encode() if isinstance(c, str) else c) for p, c in files.items())]
    return spark.createDataFrame([(p, n, t, bytearray(c)) for p, n, t, c in rows], FILES)


@F.pandas_udf(T.StringType())
def _legacy(content: pd.Series) -> pd.Series:
    """Bytes of code page 1251, which the built-in decoder does not offer."""
    return content.map(lambda b: None if b is None else bytes(b).decode("cp1251", "replace"))


@F.pandas_udf(T.StringType())
def _wide(content: pd.Series) -> pd.Series:
    """UTF-32 with its mark, which the built-in decoder does not offer everywhere."""
    return content.map(lambda b: bytes(b).decode("utf-32", "replace"))


def decode(files: DataFrame) -> DataFrame:
    """Add ``text``: by byte order mark (UTF-8, UTF-16, UTF-32), else as UTF-8 where valid, else as code page 1251.

    Valid files stay in the JVM; only UTF-32 and code page 1251 pass through Arrow, each in a branch of its own.
    """
    c, mark = F.col("content"), F.hex(F.substring("content", 1, 4))
    cut = lambda n: F.substr(c, F.lit(n + 1))
    wide = mark.isin("FFFE0000", "0000FEFF")
    marked = F.when(mark.startswith("EFBBBF"), F.decode(cut(3), "utf-8")).when(mark.startswith("FFFE"), F.decode(cut(2), "utf-16le")).when(mark.startswith("FEFF"), F.decode(cut(2), "utf-16be"))
    fine = F.expr("is_valid_utf8(cast(content as string))")
    told = mark.startswith("FFFE") | mark.startswith("FEFF") | fine
    easy = files.where(~wide & told).withColumn("text", F.coalesce(marked, c.cast("string")))
    return easy.unionByName(files.where(~wide & ~told).withColumn("text", _legacy("content"))).unionByName(files.where(wide).withColumn("text", _wide("content")))


def sections(files: DataFrame, wanted: list[str]) -> DataFrame:
    """Files of the sections (first folders); files at the root always stay."""
    return files.where(~F.col("path").contains("/") | F.split_part("path", F.lit("/"), F.lit(1)).isin(*wanted))


# Fixed values of the container format: the table of entries, the header of a block, and where a record keeps its name.
TABLE, ENTRIES, ENTRY, HEADER, NAME_AT, STORAGE = 47, 7, 12, 31, 51, "filestorage"


def block_chain(data: memoryview, address: int) -> Iterator[memoryview]:
    """Contents of the blocks of a chain in its order, wherever they lie. A block begins with a header of hexadecimal fields:
    length of the whole, length of the block, place of the next. A chain ends at a place outside, at one that was there
    before, or at a header that cannot be read; contents are views, so nothing is copied."""
    seen: set[int] = set()
    while 0 < address <= len(data) - HEADER and address not in seen:
        seen.add(address)
        head = bytes(data[address : address + HEADER])
        try:
            size, following = int(head[11:19], 16), int(head[20:28], 16)
        except ValueError:
            return
        yield data[address + HEADER : min(address + HEADER + size, len(data))]
        address = following if following < 0x7FFFFFFF else 0


def stored_files(data: bytes) -> bytes | None:
    """The payload of the entry ``FileStorage`` of a container, put together from its chain of blocks; None without one."""
    view = memoryview(data)
    for at in range(TABLE, TABLE + ENTRIES * ENTRY, ENTRY):
        if at + 8 > len(data):
            return None
        record, content = (int.from_bytes(view[i : i + 4], "little", signed=True) for i in (at, at + 4))
        if not (0 < record < len(data) and 0 < content < len(data)):
            continue
        name = bytes(view[record + NAME_AT : record + NAME_AT + 400])
        if name[: len(name) // 2 * 2].decode("utf-16-le", "replace").split("\0")[0].lower() == STORAGE:
            return b"".join(block_chain(view, content)) or None
    return None


def topics_of_archives(archives: DataFrame) -> DataFrame:
    """``path, html`` of the topics in help containers ``(content)``: the chain of blocks that the entry ``FileStorage``
    names holds a ZIP of pages. A file without such an entry is searched for a ZIP instead; a broken one gives no rows.
    Pages are handed on one container at a time."""

    def pages(data: bytes) -> list[tuple[str, str]]:
        import io
        import zipfile

        stored = stored_files(data)
        at = 0 if stored is not None else data.find(b"PK\x03\x04")
        data = data if stored is None else stored
        while at >= 0:
            try:
                with zipfile.ZipFile(io.BytesIO(data[at:])) as z:
                    return [(n, z.read(n).decode("utf-8", "replace")) for n in z.namelist() if n.lower().endswith((".html", ".htm"))]
            except zipfile.BadZipFile:
                at = data.find(b"PK\x03\x04", at + 4)
        return []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                yield pd.DataFrame(pages(bytes(content)), columns=["path", "html"])

    return archives.select("content").mapInPandas(run, "path string, html string")
