"""Chat formatting by perspective rotation: every participant of a dialogue in turn is the assistant.

For each participant the dialogue is rendered once, with their turns as the assistant's and those of all others as
turns of a named user. The mask lists the stretches that are to be learned: the assistant's words with their closing mark.
System turns are shown to everyone and nobody takes their part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURNS_PER_PART = 256
"""Turn numbers in one part of a rendered dialogue, so that a dialogue of any length never meets in one row."""

SYSTEM = "system"
CLOSE = "<|end|>\n"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def perspectives(turns: DataFrame, turns_per_part: int = TURNS_PER_PART) -> DataFrame:
    """One row per dialogue, participant and part: conv_id, perspective, part, text, mask, n_turns, n_own.

    ``turns`` has conv_id, turn, role and text. A part holds the turns numbered part * turns_per_part and on; its texts
    in the order of parts, turns without number last, make up the whole dialogue. Within a part turns follow by number, then role, then text,
    so ties and repeated rows have one order, and each repeat is rendered. ``mask`` is an array of (start, end) in
    characters of the part's text. A null text is an empty turn, a null role is the participant ``unknown``; a null
    conv_id is a dialogue of its own. A dialogue of system turns alone has no participant and no row. A participant
    without turns in a part still gets it, with an empty mask.
    """
    said = turns.selectExpr(
        "conv_id",
        f"CASE WHEN turn IS NULL THEN {1 << 40} ELSE floor(turn / {turns_per_part}) END AS part",
        "named_struct('turn', turn, 'role', coalesce(role, 'unknown'), 'text', coalesce(text, '')) AS said",
    )
    # Numbers sort before no number: struct order has nulls first, so they carry a flag of their own.
    parts = said.groupBy("conv_id", "part").agg(
        F.expr(
            """transform(array_sort(collect_list(struct(said.turn IS NULL AS late, said AS said))), x -> x.said)"""
        ).alias("said")
    )
    people = said.where(f"said.role <> '{SYSTEM}'").select("conv_id", F.col("said.role").alias("perspective")).distinct()
    shown = parts.alias("p").join(people.alias("q"), F.expr("p.conv_id <=> q.conv_id")).selectExpr(
        "p.conv_id", "perspective", "part", "said"
    )
    head = f"""CASE WHEN s.role = perspective THEN {_quoted("<|assistant|>\n")}
                    WHEN s.role = '{SYSTEM}' THEN {_quoted("<|system|>\n")}
                    ELSE concat('<|user name=', s.role, {_quoted("|>\n")}) END"""
    pieces = shown.selectExpr(
        "conv_id", "perspective", "part",
        f"""transform(said, s -> named_struct('head', {head}, 'body', concat(s.text, {_quoted(CLOSE)}),
                                             'own', s.role = perspective)) AS pieces""",
    )
    mask = """aggregate(pieces, named_struct('at', 0L, 'mask', CAST(array() AS ARRAY<STRUCT<start: BIGINT, end: BIGINT>>)),
        (s, x) -> named_struct('at', s.at + length(x.head) + length(x.body),
            'mask', IF(x.own, concat(s.mask, array(named_struct('start', s.at + length(x.head),
                                                                'end', s.at + length(x.head) + length(x.body)))), s.mask)),
        s -> s.mask)"""
    return pieces.selectExpr(
        "conv_id", "perspective", "part",
        "array_join(transform(pieces, x -> concat(x.head, x.body)), '') AS text",
        f"{mask} AS mask",
        "CAST(size(pieces) AS BIGINT) AS n_turns",
        "CAST(size(filter(pieces, x -> x.own)) AS BIGINT) AS n_own",
    )


def digest(rendered: DataFrame) -> DataFrame:
    """The rendered dialogues with the mask as text, start:end joined by blanks, and the number of learned characters."""
    return rendered.selectExpr(
        "conv_id", "perspective", "part", "text",
        "array_join(transform(mask, m -> concat(m.start, ':', m.end)), ' ') AS mask",
        "aggregate(mask, 0L, (n, m) -> n + m.end - m.start) AS n_learned", "n_turns", "n_own",
    )


def oracle_sql(turns_per_part: int = TURNS_PER_PART) -> str:
    """``digest`` over conversations in DuckDB's SQL, with windows over the turns of a part."""
    return f"""
    WITH s AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
                      CASE WHEN turn IS NULL THEN {1 << 40} ELSE CAST(floor(turn / {turns_per_part}) AS BIGINT) END AS part
               FROM conversations),
    q AS (SELECT DISTINCT conv_id, role AS perspective FROM s WHERE role <> '{SYSTEM}'),
    r AS (SELECT s.conv_id, perspective, part, turn, role, text, role = perspective AS own,
                 CASE WHEN role = perspective THEN '<|assistant|>' WHEN role = '{SYSTEM}' THEN '<|system|>'
                      ELSE '<|user name=' || role || '|>' END || chr(10) AS head, text || '<|end|>' || chr(10) AS body
          FROM s JOIN q ON s.conv_id IS NOT DISTINCT FROM q.conv_id),
    o AS (SELECT *, row_number() OVER (w ORDER BY turn NULLS LAST, role, text) AS k,
                 sum(length(head) + length(body)) OVER (w ORDER BY turn NULLS LAST, role, text ROWS UNBOUNDED PRECEDING) AS stop
          FROM r WINDOW w AS (PARTITION BY conv_id, perspective, part))
    SELECT conv_id, perspective, part, string_agg(head || body, '' ORDER BY k) AS text,
           coalesce(string_agg(CASE WHEN own THEN (stop - length(body)) || ':' || stop END, ' ' ORDER BY k), '') AS mask,
           CAST(coalesce(sum(CASE WHEN own THEN length(body) END), 0) AS BIGINT) AS n_learned,
           count(*) AS n_turns, count(*) FILTER (WHERE own) AS n_own
    FROM o GROUP BY ALL"""
