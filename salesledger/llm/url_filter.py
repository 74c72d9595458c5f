"""URL filter: rules for hosts and paths first, character language models of accepted and rejected URLs for the rest.

1. A rule allows or blocks a host with its subdomains, below a path; the longest rule that fits decides.
2. The URLs that a rule allows and those that a rule blocks train a Markov model each, over the bytes of a URL. A byte's chance
   after up to ORDER bytes mixes the counts of all shorter contexts (Witten-Bell): the more different bytes a context was
   seen with, the more the next shorter one has to say, down to equal chances for all 256.
3. A URL's score is the sum of its bytes' log ratios (accepted to rejected) by its length.
4. Scores of a fifth of the ruled URLs, kept out of the training, set the threshold with the least sum of both error rates.

A run of bytes with its context is one 64-bit number, so shorter contexts are its low bytes: runs are counted once, and the
counts of shorter ones follow from the distinct runs. A run is joined with its shorter forms, each of which meets 256 at
most; URLs ask for the ratios of a whole block's distinct runs, so a run that all URLs have is one row a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesledger.llm.staging import staged

ORDER = 4
BITS = 8
FINE = 100
"""Scores are compared in hundredths; from -LIMIT to LIMIT, so the threshold is found among a bounded number of values."""

LIMIT = 1000
BLOCK = 1024
"""URLs that are scored together."""

LONG = 8192
"""Bytes from which on a URL is a block of its own."""

SLICE_BYTES = 4 << 20


@dataclass(frozen=True)
class Rule:
    """``verdict`` for the URLs of ``host`` and its subdomains whose path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self) -> str:
        host, path = _text(self.host), _text(self.path)
        return f"((host = {host} OR endswith(host, {_text('.' + self.host)})) AND startswith(path, {path}))"


RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def parted(url: str) -> dict[str, str]:
    """SQL of host (A-Z lower-cased) and path of a URL column; both empty where it is null or has no ``://``."""
    text = f"coalesce(CAST({url} AS STRING), '')"
    return {
        "host": f"translate(regexp_extract({text}, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')",
        "path": f"regexp_extract({text}, '://[^/?#]*([^?#]*)', 1)",
    }


def ruled(urls: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``urls`` (url and others) with host, path, rule and ruling, null where no rule fits. Of rules as long as each
    other the first by name decides. The rules are compiled into the projection, so they are a list of bounded length."""
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.name))
    cases = {
        "rule": [f"WHEN {r.fits()} THEN {_text(r.name)}" for r in ordered],
        "ruling": [f"WHEN {r.fits()} THEN {_text(r.verdict)}" for r in ordered],
    }
    out = urls.withColumns({name: F.expr(sql) for name, sql in parted("url").items()})
    return out.withColumns(
        {name: F.expr(f"CASE {' '.join(whens)} END" if whens else "CAST(NULL AS STRING)") for name, whens in cases.items()}
    )


def kept_out(url: str = "url") -> Column:
    """The fifth of the URLs that sets the threshold."""
    return F.crc32(F.col(url).cast("binary")) % 5 == 0


def runs_of(urls: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Each byte of each URL, and its end, with the ``order`` bytes before it as one number; and the ends of the URLs in these.

    Zeros stand before the first byte, a one after the last.
    """
    lengths = np.array([len(u) + 1 for u in urls], np.int64)
    ends = np.cumsum(lengths)
    raw = np.frombuffer(b"".join(u + b"\x01" for u in urls), np.uint8).astype(np.uint64)
    at = np.arange(len(raw)) - np.repeat(ends - lengths, lengths)
    runs = raw.copy()
    for k in range(1, order + 1):
        before = np.zeros(len(raw), np.uint64)
        before[k:] = raw[:-k] if k < len(raw) else 0
        before[at < k] = 0
        runs |= before << np.uint64(BITS * k)
    return runs.view(np.int64), ends


def _slices(urls: list[bytes]) -> Iterator[tuple[int, int]]:
    at, size = 0, 0
    for i, url in enumerate(urls):
        if i > at and size + len(url) > SLICE_BYTES:
            yield at, i
            at, size = i, 0
        size += len(url)
    yield at, len(urls)


def _bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def _counted(order: int):
    """Runs of each block with how often accepted and rejected URLs of the training have them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls, blocks = _bytes(batch["url"]), batch["block"].to_numpy()
            sides = [batch[name].to_numpy(zero_copy_only=False).astype(np.int64) for name in ("accepted", "rejected")]
            for start, stop in _slices(urls):
                if start == stop:
                    continue
                runs, ends = runs_of(urls[start:stop], order)
                lengths = np.diff(np.concatenate([[0], ends]))
                block = np.repeat(blocks[start:stop], lengths)
                sort = np.lexsort((runs, block))
                runs, block = runs[sort], block[sort]
                new = np.flatnonzero(np.concatenate([[True], (runs[1:] != runs[:-1]) | (block[1:] != block[:-1])]))
                sums = [np.add.reduceat(np.repeat(side[start:stop], lengths)[sort], new) for side in sides]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block[new]), pa.array(runs[new]), *map(pa.array, sums)], ["block", "run", "accepted", "rejected"]
                )

    return count


def ratios(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """Log of accepted to rejected chance of each run (run, ratio), from how often both sides have it (run, accepted, rejected).

    Without any URL on one side its chances are equal for all bytes; without any on both sides all ratios are 0.
    """
    below = None
    for length in range(1, order + 2):
        low = (1 << BITS * length) - 1
        level = counts.groupBy(F.expr(f"run & {low}L").alias("run")).agg(
            F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")
        )
        level = _with_context(level, low)
        if below is None:
            chances = level.selectExpr("run", *[_chance(side, "1D / 256") for side in ("accepted", "rejected")])
        else:
            chances = level.join(
                below.withColumnsRenamed({"run": "shorter", "accepted": "a", "rejected": "r"}), "shorter"
            ).selectExpr("run", _chance("accepted", "a"), _chance("rejected", "r"))
        below = staged(chances, "chances")
    return below.selectExpr("run", "ln(accepted) - ln(rejected) AS ratio")


def _with_context(level: DataFrame, low: int) -> DataFrame:
    """Runs with the sums over the runs of their context, 256 at most: its occurrences and the kinds of bytes after it."""
    sides = ("accepted", "rejected")
    return level.selectExpr("*", f"run & {low >> BITS}L AS shorter", f"shiftrightunsigned(run, {BITS}) AS context").selectExpr(
        "run", "shorter", *sides,
        *[f"sum({s}) OVER (PARTITION BY context) AS {s}_all" for s in sides],
        *[f"sum(int({s} > 0)) OVER (PARTITION BY context) AS {s}_kinds" for s in sides],
    )


def _chance(side: str, shorter: str) -> str:
    return f"""CASE WHEN {side}_all = 0 THEN {shorter}
               ELSE ({side} + {side}_kinds * {shorter}) / ({side}_all + {side}_kinds) END AS {side}"""


def _scored(order: int, columns: list[str]):
    """Score of each URL of a block from the ratios of the block's runs."""

    def score(urls: pa.Table, found: pa.Table) -> pa.Table:
        run, ratio = (found[name].combine_chunks().to_numpy() for name in ("run", "ratio"))
        sort = np.argsort(run)
        run, ratio = run[sort], ratio[sort]
        texts, scores = _bytes(urls["url"].combine_chunks()), []
        for start, stop in _slices(texts):
            if start < stop:
                own, ends = runs_of(texts[start:stop], order)
                starts = np.concatenate([[0], ends[:-1]])
                sums = np.add.reduceat(ratio[np.searchsorted(run, own)], starts)
                scores.append(sums / (ends - starts))
        return urls.select(columns).append_column("score", pa.array(np.concatenate(scores or [np.zeros(0)])))

    return score


def verdicts(
    pages: DataFrame, rules: tuple[Rule, ...] = RULES, order: int = ORDER, key: str = "page_id", url: str = "url"
) -> DataFrame:
    """One row per row of ``pages``: the key, url, host, path, rule, score and verdict (allow or block).

    The rule's verdict counts where one fits, else ``allow`` from the threshold on. Ruled URLs have a score as well. All ruled
    URLs outside the fifth of ``kept_out`` train the models, whatever their number; each row counts, so a URL on two rows counts twice.
    A null URL is an empty one: no rule, no training, score 0. Where one side has no URL to set the threshold it is 0. Columns of
    ``pages`` other than key and url are not read. URLs of any length are scored whole.
    """
    if not 1 <= order <= 6:
        raise ValueError("a context has 1 to 6 bytes")
    given = pages.select(F.col(key).alias("id"), F.col(url).cast("string").alias("given"))
    urls = ruled(given.withColumn("url", F.coalesce("given", F.lit(""))), rules)
    # A block is a stretch of one partition: numbers of partitions are the upper 31 bits.
    urls = urls.withColumn("at", F.monotonically_increasing_id()).withColumns(
        {
            "block": F.expr(f"IF(octet_length(url) > {LONG}, -1 - at, at DIV {BLOCK})"),
            "trains": F.expr("ruling IS NOT NULL AND given IS NOT NULL") & ~kept_out(),
        }
    )
    urls = staged(urls, "urls")

    sides = [F.expr(f"trains AND ruling = '{v}'").alias(name) for v, name in (("allow", "accepted"), ("block", "rejected"))]
    runs = urls.where("given IS NOT NULL").select("block", "url", *sides).mapInArrow(
        _counted(order), "block long, run long, accepted long, rejected long"
    )
    runs = staged(runs, "runs")
    ratio = ratios(runs.groupBy("run").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")), order)
    asked = runs.select("block", "run").distinct().join(ratio, "run")
    columns = ["id", "given", "host", "path", "rule", "ruling"]
    scored = urls.where("given IS NOT NULL").select("block", "url", *columns).groupBy("block").cogroup(
        asked.groupBy("block")
    ).applyInArrow(
        _scored(order, columns),
        f"id {pages.schema[key].dataType.simpleString()}, given string, host string, path string, rule string, ruling string, score double",
    )
    scored = staged(scored, "scored").unionByName(
        urls.where("given IS NULL").select(*columns, F.lit(0.0).alias("score"))
    )
    fine = f"greatest(-{LIMIT}, least({LIMIT}, CAST(floor(greatest(-1e9D, least(1e9D, score * {FINE}))) AS INT)))"
    limit = threshold(scored.where(F.col("ruling").isNotNull() & kept_out("given")).selectExpr("ruling", f"{fine} AS fine"))
    return scored.selectExpr(
        f"id AS `{key}`", f"given AS `{url}`", "host", "path", "rule", "score",
        f"coalesce(ruling, IF({fine} >= {limit}, 'allow', 'block')) AS verdict",
    )


def threshold(ruled_scores: DataFrame) -> int:
    """Least score from which on to allow, by the least sum of the shares of accepted URLs below and rejected ones above.

    ``ruled_scores`` has (ruling, fine); at most 2 * LIMIT + 1 sums reach the driver. All thresholds between two neighbouring
    scores are as good: the middle one is taken, of the lowest such stretch.
    """
    sums = ruled_scores.groupBy("fine").agg(
        F.sum(F.expr("int(ruling = 'allow')")).alias("accepted"), F.sum(F.expr("int(ruling = 'block')")).alias("rejected")
    )
    rows = sorted(tuple(r) for r in sums.collect())
    accepted, rejected = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not accepted or not rejected:
        return 0
    best, lost, passed, before = None, 0, rejected, rows[0][0]
    for fine, a, r in rows:
        cost = lost / accepted + passed / rejected
        if best is None or cost < best[0]:
            best = (cost, fine - (fine - before) // 2)
        lost, passed, before = lost + a, passed - r, fine
    return best[1]


def oracle_sql(rules: tuple[Rule, ...] = RULES, order: int = ORDER) -> str:
    """The query's columns in DuckDB's SQL: runs are strings of hexadecimal digits, every level is joined anew."""
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.name))
    fits = {r: r.fits().replace("endswith", "ends_with").replace("startswith", "starts_with") for r in ordered}
    whens = {part: " ".join(f"WHEN {fits[r]} THEN '{getattr(r, part)}'" for r in ordered) for part in ("name", "verdict")}
    crc = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, CAST(strlen(url) AS BIGINT)),
                 lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
             lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295)"""
    wide = 2 * (order + 1)
    levels = ""
    for length in range(1, order + 2):
        digits = 2 * length
        chances = [
            f"""CASE WHEN sum(l.{s}) OVER w = 0 THEN {prior}
                ELSE (l.{s} + sum(CASE WHEN l.{s} > 0 THEN 1 ELSE 0 END) OVER w * {prior})
                     / (sum(l.{s}) OVER w + sum(CASE WHEN l.{s} > 0 THEN 1 ELSE 0 END) OVER w) END AS p{s}"""
            for s, prior in (("a", "b.pa" if length > 1 else "1 / 256::DOUBLE"), ("r", "b.pr" if length > 1 else "1 / 256::DOUBLE"))
        ]
        levels += f"""
    c{length} AS (SELECT right(run, {digits}) AS run, CAST(sum(a) AS DOUBLE) AS a, CAST(sum(r) AS DOUBLE) AS r FROM g GROUP BY ALL),
    p{length} AS (SELECT l.run, {", ".join(chances)} FROM c{length} AS l
           {f"JOIN p{length - 1} AS b ON b.run = right(l.run, {digits - 2})" if length > 1 else ""}
           WINDOW w AS (PARTITION BY left(l.run, {digits - 2}))),"""
    return f"""
    WITH u AS (SELECT page_id, url, hex(encode(coalesce(url, ''))) AS x,
                      translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                      regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS k FROM pages),
    v AS (SELECT *, CASE {whens["name"]} END AS rule, CASE {whens["verdict"]} END AS ruling, {crc} % 5 = 0 AS held FROM u),
    o AS (SELECT k, CASE WHEN held THEN NULL ELSE ruling END AS side,
                 substr(repeat('0', {wide - 2}) || x || '01', 2 * i + 1, {wide}) AS run
          FROM v, unnest(range(0, CAST(strlen(url) AS BIGINT) + 1)) AS t(i) WHERE url IS NOT NULL),
    g AS (SELECT run, count(*) FILTER (WHERE side = 'allow') AS a, count(*) FILTER (WHERE side = 'block') AS r FROM o GROUP BY run),
    {levels.strip()}
    s AS (SELECT k, CAST(greatest(-{LIMIT}, least({LIMIT}, floor({FINE} * sum(ln(pa) - ln(pr)) / count(*)))) AS INT) AS fine
          FROM o JOIN p{order + 1} USING (run) GROUP BY k),
    f AS (SELECT v.*, coalesce(s.fine, 0) AS fine FROM v LEFT JOIN s USING (k)),
    h AS (SELECT fine, sum(CASE ruling WHEN 'allow' THEN 1 ELSE 0 END) AS a, sum(CASE ruling WHEN 'block' THEN 1 ELSE 0 END) AS r
          FROM f WHERE held AND ruling IS NOT NULL GROUP BY fine),
    t AS (SELECT fine - (fine - lag(fine, 1, fine) OVER up) // 2 AS fine, (sum(a) OVER up - a) / sum(a) OVER () + (sum(r) OVER () - sum(r) OVER up + r) / sum(r) OVER () AS cost,
                 sum(a) OVER () > 0 AND sum(r) OVER () > 0 AS both_sides
          FROM h WINDOW up AS (ORDER BY fine))
    SELECT page_id, host, path, rule,
           coalesce(ruling, CASE WHEN fine >= coalesce((SELECT min_by(fine, (cost, fine)) FROM t WHERE both_sides), 0)
                                 THEN 'allow' ELSE 'block' END) AS verdict
    FROM f"""
