"""Quality rules: a table of thresholds on measures of a text, compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesledger.llm.columns import fresh

SPACES = r"\x20\x09-\x0D"
_QUOTED = SPACES.replace("\\", "\\\\")
"""The same inside a string of Spark's SQL."""
SYMBOLS = "#*$%&|<>"

# --- fixed values: frequent function words of the languages of the corpus ---
STOP_WORDS = {
    "en": "the of and to a in is that for with was as it on be by this are at or an",
    "fr": "le la les de des du et un une en que qui dans pour est par sur au ce ne",
    "de": "der die das und in den von zu mit sich des auf ist im dem nicht ein eine als auch",
    "es": "el la los las de del y que en un una por con para es se al lo como no",
}


@dataclass(frozen=True)
class Rule:
    """A row of the threshold table.

    A text passes with low <= 100 * part / whole <= high; a bound that is None is not asked. Only texts with at least
    ``min_words`` words are asked.
    """

    name: str
    part: str
    whole: str
    low: int | None = None
    high: int | None = None
    min_words: int = 0

    def fails(self) -> str:
        bounds = [f"100 * {self.part} < {self.low} * {self.whole}"] if self.low is not None else []
        bounds += [f"100 * {self.part} > {self.high} * {self.whole}"] if self.high is not None else []
        return f"(n_words >= {self.min_words} AND ({' OR '.join(bounds)}))"


BASE = (
    Rule("words", "n_words", "1", low=1000),
    Rule("repeated_words", "n_repeat_words", "n_words", high=20),
)
"""Rules behind ``base_failed``."""

RULES = (
    Rule("word_length", "word_chars", "n_words", low=200, high=1500),
    Rule("symbols", "n_symbols", "n_words", high=20),
    Rule("stop_words", "n_stop_words", "n_words", low=1, min_words=50),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=50),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", high=90, min_words=50),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", high=30, min_words=50),
)
"""Rules of the verdict beyond the base. The bounds leave room: they are meant for junk, not for unusual prose."""


def stop_list(stop_words: dict[str, str]) -> str:
    return ", ".join(f"'{word}'" for word in sorted({word for text in stop_words.values() for word in text.split()}))


def measures(docs: DataFrame, stop_words: dict[str, str] = STOP_WORDS) -> DataFrame:
    """``docs`` with the measures of ``text`` as further long columns; a null text counts as an empty one.

    Columns of ``docs`` with the name of a measure are replaced.
    """
    text = "coalesce(CAST(text AS STRING), '')"
    w, l, h = (fresh(name, docs.columns) for name in ("words", "lines", "hashes"))
    split = docs.selectExpr(
        "*",
        f"filter(split({text}, '[{_QUOTED}]+'), x -> x <> '') AS {w}",
        rf"filter(split({text}, '\n'), x -> x RLIKE '[^{_QUOTED}]') AS {l}",
    )
    # A window of 5 words as a 64-bit hash, by its first word.
    hashed = split.selectExpr(
        "*",
        f"""if(size({w}) < 5, CAST(array() AS ARRAY<BIGINT>), transform(sequence(0, size({w}) - 5),
             i -> xxhash64({w}[i], {w}[i + 1], {w}[i + 2], {w}[i + 3], {w}[i + 4]))) AS {h}""",
    )
    # Where all windows differ, which a hash set tells, no more is done. Else equal windows are neighbours once sorted; each
    # first word of such a window adds the words up to the next such, 5 at most, so no word counts twice.
    starts = f"""sort_array(transform(
        transform(array(sort_array(transform({h}, (h, i) -> struct(h AS h, i AS i)))),
                  s -> filter(s, (p, k) -> coalesce(p.h = get(s, k - 1).h, false) OR coalesce(p.h = get(s, k + 1).h, false)))[0],
        p -> p.i))"""
    measured = {
        "n_words": f"size({w})",
        "word_chars": f"length(regexp_replace({text}, '[{_QUOTED}]+', ''))",
        "n_symbols": f"length({text}) - length(translate({text}, '{SYMBOLS}', ''))",
        "n_lines": f"size({l})",
        "n_dup_lines": f"size({l}) - size(array_distinct({l}))",
        "n_repeat_words": f"""CASE WHEN size(array_distinct({h})) = size({h}) THEN 0 ELSE
            aggregate({starts}, named_struct('n', 0, 'at', -5),
                      (s, i) -> named_struct('n', s.n + least(5, i - s.at), 'at', i), s -> s.n) END""",
        "n_stop_words": f"size(filter({w}, x -> lower(x) IN ({stop_list(stop_words)})))",
        "n_bullet_lines": f"size(filter({l}, x -> x RLIKE '^[{_QUOTED}]*[-*•]'))",
        "n_ellipsis_lines": f"size(filter({l}, x -> x RLIKE '([.][.][.]|…)[{_QUOTED}]*$'))",
    }
    return hashed.withColumns({name: F.expr(f"CAST({sql} AS BIGINT)") for name, sql in measured.items()}).drop(
        w, l, h
    )


def failed(rules: tuple[Rule, ...]) -> str:
    """SQL of the threshold table: whether any rule fails."""
    return " OR ".join(rule.fails() for rule in rules) if rules else "false"


def quality(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE, stop_words: dict[str, str] = STOP_WORDS
) -> DataFrame:
    """``docs`` with the measures, ``base_failed``, ``kept`` and ``failed_rules``, the names of the rules that fail.

    Every row gets a verdict of its own: null, empty and blank texts have no words and fail the base, repeated rows are
    judged alike, texts of any length are read whole.
    """
    measured = measures(docs, stop_words)
    names = ", ".join(f"CASE WHEN {rule.fails()} THEN '{rule.name}' END" for rule in (*base, *rules))
    return measured.withColumns(
        {
            "base_failed": F.expr(failed(base)),
            "kept": F.expr(f"NOT ({failed((*base, *rules))})"),
            "failed_rules": F.expr(f"array_compact(array({names}))"),
        }
    )


def oracle_sql(rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE) -> str:
    """The query's columns in DuckDB's SQL, windows counted as joined words."""
    return rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text,
                      regexp_extract_all(coalesce(text, ''), '[^{SPACES}]+') AS w,
                      list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{SPACES}]')) AS l
               FROM documents),
    g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM d, unnest(range(1, len(w) - 3)) AS t(i)),
    twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
    r AS (SELECT doc_id, count(DISTINCT p) AS n FROM twice, unnest(range(i, i + 5)) AS t(p) GROUP BY doc_id),
    m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
                 CAST(length(regexp_replace(text, '[{SPACES}]+', '', 'g')) AS BIGINT) AS word_chars,
                 CAST(length(regexp_replace(text, '[^{SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols,
                 CAST(len(l) AS BIGINT) AS n_lines,
                 CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
                 CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
                 len(list_filter(w, lambda x: lower(x) IN ({stop_list(STOP_WORDS)}))) AS n_stop_words,
                 len(list_filter(l, lambda x: regexp_matches(x, '^[{SPACES}]*[-*•]'))) AS n_bullet_lines,
                 len(list_filter(l, lambda x: regexp_matches(x, '([.][.][.]|…)[{SPACES}]*$'))) AS n_ellipsis_lines
          FROM d LEFT JOIN r USING (doc_id))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           {failed(base)} AS base_failed, NOT ({failed((*base, *rules))}) AS kept
    FROM m"""
