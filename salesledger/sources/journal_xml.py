"""Ledger journal from the XML spreadsheets an accounting program exports.

Each workbook is parsed by one task, so many workbooks are read in parallel. A task holds the file, at most 2 GB, and the journal's
cells, of which a worksheet has at most 1,048,576 rows by the limits of the file format. Files that hold plain rows only, as the
program writes them, are read by patterns over whole columns; any other file goes through Python's expat element by element, and so
does a packed file that unpacks to more than 128 MB.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesledger import schema as S

# --- fixed values ------------------------------------------------------------------------------------
SHEET = "Journal"
HEADERS = {
    "date": "Date",
    "description": "Description",
    "debit": "AccountDebit",
    "credit": "AccountCredit",
    "amount": "Amount",
}
POSITIONS = {"date": 8, "description": 20, "debit": 22, "credit": 24, "amount": 29}
ABSENT = {"description": "description missing", "debit": "debit missing", "credit": "credit missing"}

BATCH = 10_000
"""Rows of a batch. Rows before the header row, or of a sheet without one, are kept with all their cells until the sheet ends."""


def read_journal(
    spark: SparkSession, path: str | list[str], positions: dict[str, int] | None = None
) -> DataFrame:
    """Journal rows that carry a date.

    Columns are found by the names in the sheet's header row; where a sheet has no such row, or ``positions`` is given,
    by their number. A cell without content is null, an amount that is no number is zero.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    cells = _cells(SHEET, HEADERS, positions or POSITIONS, by_name=positions is None, batch=BATCH)
    texts = files.mapInArrow(cells, ", ".join(f"{name} STRING" for name in HEADERS))
    is_date = r"left(date, 10) RLIKE r'^\d{4}-\d{2}-\d{2}\z'"
    return texts.where(is_date).selectExpr(
        "CAST(left(date, 10) AS DATE) AS date",
        *[f"coalesce({name}, '{text}') AS {name}" for name, text in ABSENT.items()],
        "coalesce(try_cast(amount AS DECIMAL(18, 2)), 0) AS amount",
    ).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in S.JOURNAL.fields])


def _cells(sheet: str, headers: dict[str, str], numbers: dict[str, int], by_name: bool, batch: int) -> Callable:
    """Function for ``mapInArrow``: the texts of the journal's columns, row by row, from whole workbooks.

    It holds all that a Python worker needs, so workers don't import this package.
    """

    def texts(workbooks):
        import re
        from xml.parsers import expat

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        nest = ("Worksheet", "Table", "Row", "Cell", "Data")
        codecs = {"gz": "gzip", "bz2": "bz2", "zst": "zstd"}
        slice_bytes = 4 << 20  # of a table, looked at at once
        unpacked_bytes = 128 << 20  # of a packed file, held at once
        blanks = "".join(map(chr, range(33)))
        whole_number = re.compile(r"[+-]?[0-9]+")

        given_names = r"""(?:\s+[\w:.-]+="[^"<>]*")*"""
        opening = re.compile(rf"({given_names})\s*>\s*<Table{given_names}\s*>".encode())
        columns_only = re.compile(rf"(?:\s*<Column{given_names}\s*/>)*\s*")
        plain_row = r"^(?:[\s/][^<>]*)?>\s*(?:</Row>\s*)?$"
        # No text can go on in two ways at any place, so the pattern needs no trying.
        more = r"""(?: [\w:.-]+="[^"<>]*")*"""
        data = rf"Data{more}(?:/|>(?P<value>[^<]*)</Data)>\s*</Cell>"
        plain_cell = rf"""^ ss:Index="(?P<at>[0-9]{{1,6}})"{more}(?:/>|>\s*<(?:{data}|/Cell>))\s*(?:</Row>\s*)?$"""
        entity = re.compile(r"&(?:#x([0-9a-fA-F]+)|#([0-9]+)|(\w+));")
        entities = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}

        def decoded(found):
            sixteen, ten, name = found.groups()
            return entities[name] if name else chr(int(sixteen, 16) if sixteen else int(ten))

        def plain_cells(part, first):
            """Rows, and of their cells the row, the number and the text, of a part of a plain table; None if it isn't plain."""
            pieces = pc.split_pattern(pa.array([part.decode()], pa.large_string()), "<Row").flatten()
            if not columns_only.fullmatch(pieces[0].as_py()) or (not first and pieces[0].as_py()):
                return None
            rows = pc.split_pattern(pieces[1:], "<Cell")
            sizes, texts = rows.value_lengths().to_numpy(), rows.flatten()
            ends = np.cumsum(sizes)
            leads, lasts = np.zeros(len(texts), dtype=bool), np.zeros(len(texts), dtype=bool)
            leads[ends - sizes], lasts[ends - 1] = True, True
            starts, cells = texts.filter(pa.array(leads)), texts.filter(pa.array(~leads))
            closed = pc.match_substring(cells, "</Row").to_numpy(False)
            if not pc.all(pc.match_substring_regex(starts, plain_row)).as_py() or np.any(closed != lasts[~leads]):
                return None
            if pc.any(pc.match_substring(starts.filter(pa.array(sizes > 1)), "/")).as_py():
                return None
            found = pc.extract_regex(cells, plain_cell)
            if found.null_count:
                return None
            at, row = pc.struct_field(found, "at").cast(pa.int64()).to_numpy(), np.repeat(np.arange(len(rows)), sizes - 1)
            if np.any(np.diff(row * 2**31 + at) <= 0):  # out of order, or a number twice
                return None
            value = pc.struct_field(found, "value")
            if pc.any(pc.match_substring(value, "&")).as_py():
                value = pa.array([entity.sub(decoded, text) for text in value.to_pylist()], pa.large_string())
            value = pc.utf8_trim(value, characters=blanks)
            return len(rows), row, at, pc.if_else(pc.equal(value, ""), None, value)

        def plain_table(parts):
            """Batches of a table in parts."""
            places = None if by_name else list(numbers.values())
            for _, row, at, value in parts:
                if places is None:
                    marks = [row[pc.fill_null(pc.equal(value, headers[name]), False).to_numpy(False)] for name in ("debit", "credit")]
                    both = np.intersect1d(*marks)
                    if len(both):
                        own = np.nonzero(row == both[0])[0]
                        names = dict(reversed([(value[i].as_py(), int(at[i])) for i in own]))
                        places = [names.get(text, numbers[name]) for name, text in headers.items()]
            for count, row, at, value in parts:
                columns = []
                for place in places or numbers.values():
                    cells, index = np.nonzero(at == place)[0], np.full(count, -1)
                    index[row[cells]] = cells
                    columns.append(value.take(pa.array(index, mask=index < 0)).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=list(headers))

        def read_plain(content):
            """The same as ``read``, by patterns over whole columns, of a well-formed file in UTF-8 that holds nothing but plain
            elements, rows of numbered cells in ascending order; None of any other file."""
            declared = content[: content.find(b"?>")].lower() if content.startswith(b"<?xml") else b""
            if b"<!" in content or b"\r" in content or content.find(b"<?", 2) >= 0 or not content.startswith(b"<"):
                return None
            if b"encoding" in declared and b'"utf-8"' not in declared:
                return None
            try:
                expat.ParserCreate().Parse(content, True)
            except expat.ExpatError:
                return None
            batches = []
            for part in content.split(b"<Worksheet")[1:]:
                found, stop = opening.match(part), part.find(b"</Table")
                if not found or stop < 0 or part.count(b"<Table") != 1:
                    return None
                name = re.search(rb"""\sss:Name="([^"]*)\"""", found[1])
                if not name or b"&" in name[1]:
                    return None
                if name[1] != sheet.encode():
                    continue
                parts, at = [], found.end()
                while at < stop:
                    cut = part.find(b"<Row", at + slice_bytes, stop)
                    cut = stop if cut < 0 else cut
                    cells = plain_cells(part[at:cut], first=not parts)
                    if cells is None:
                        return None
                    parts.append(cells)
                    at = cut
                batches.extend(plain_table(parts))
            return batches

        def table(rows, places):
            columns = [pa.array([row.get(place) for row in rows], pa.string()) for place in places]
            return pa.RecordBatch.from_arrays(columns, names=list(headers))

        def read(stream):
            """Batches of the file's journals. What follows a fault in the file, and the sheet it stands in, is left out."""
            ready, batches, rows, row, words = [], [], [], {}, []
            inside = depth = 0  # open elements that follow ``nest``, and all open elements from the worksheet on
            number = value = places = None
            wanted = readable = False

            def settle():
                """The text up to here. Of several, parted by elements or comments, the last counts."""
                nonlocal value
                if words:
                    value = "".join(words).strip(blanks) or value
                    words.clear()

            def start(name, given):
                nonlocal inside, depth, number, value, places, wanted, readable
                if inside == depth and inside < 5 and name == nest[inside]:
                    inside += 1
                    depth += 1
                    if inside > 3:
                        value = None
                        if inside == 4:
                            number = given.get("ss:Index")
                    elif inside == 1:
                        wanted, readable = given.get("ss:Name") == sheet, True
                        places = None if by_name else [numbers[name] for name in headers]
                        parser.CharacterDataHandler = text if wanted else None
                    elif inside == 2:  # of several tables the last counts
                        rows.clear()
                        batches.clear()
                        places = None if by_name else places
                elif depth:
                    depth += 1
                    settle()

            def end(name):
                nonlocal inside, depth, row, readable
                if not depth:
                    return
                if inside == depth:
                    inside -= 1
                    if inside == 4:
                        settle()
                    elif inside == 3:
                        if wanted and number is not None:
                            if whole_number.fullmatch(number.strip(blanks)) is None:
                                readable = False
                            elif (at := int(number)) in row:
                                raise ValueError(f"a row of the journal has cell {at} twice")
                            else:
                                row[at] = value
                    elif inside == 2:
                        if row:
                            rows.append(row)
                            seek(row)
                            row = {}
                            if places and len(rows) >= batch:
                                batches.append(table(rows, places))
                                rows.clear()
                    elif inside == 0:
                        if wanted and readable:
                            ready.extend(batches)
                            ready.append(table(rows, places or numbers.values()))
                        rows.clear()
                        batches.clear()
                else:
                    settle()
                depth -= 1

            def seek(row):
                """The places of the columns, if this is the first header row."""
                nonlocal places
                if places is None:
                    found = set(row.values())
                    if headers["debit"] in found and headers["credit"] in found:
                        names = {value: number for number, value in reversed(row.items())}
                        places = [names.get(text, numbers[name]) for name, text in headers.items()]

            def text(data):
                if inside == 5 == depth:
                    words.append(data)

            parser = expat.ParserCreate()
            parser.buffer_text = True
            parser.StartElementHandler, parser.EndElementHandler = start, end
            parser.CommentHandler = parser.ProcessingInstructionHandler = lambda *_: settle()
            try:
                while piece := stream.read(1 << 20):
                    parser.Parse(piece, False)
                    yield from ready
                    ready.clear()
                parser.Parse(b"", True)
            except expat.ExpatError:
                pass
            yield from ready

        def unpacked(stream):
            """The whole content of a packed file; None if it is larger than what is held at once, or has a fault."""
            pieces, size = [], 0
            try:
                while size <= unpacked_bytes and (piece := stream.read(1 << 20)):
                    pieces.append(piece)
                    size += len(piece)
            except OSError:
                return None
            return b"".join(pieces) if size <= unpacked_bytes else None

        for given in workbooks:
            for path, content in zip(given.column("path"), given.column("content")):
                codec = codecs.get(path.as_py().rsplit(".", 1)[-1])
                whole = unpacked(pa.input_stream(content.as_buffer(), compression=codec)) if codec else content.as_py()
                batches = None if whole is None else read_plain(whole)
                yield from read(pa.input_stream(content.as_buffer(), compression=codec)) if batches is None else batches

    return texts
