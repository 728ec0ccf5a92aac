"""Chat formatting by relational expressions.

The turns of a conversation are collected as structs and sorted; neighbours of one role are merged
into a block, and the blocks are concatenated:

    ### role: text</turn>            a block of one turn, with a line end after it
    ### role: text<also>text</turn>  a block of two turns of the same role

In texts and roles a backslash becomes \\b, < becomes \\l and # becomes \\h, in roles : becomes \\c:
no control string is left in them, and the replacement can be undone. The loss mask is the place
of every assistant text, as start and length in code points, without the marks around it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_guard.functions import text as tx
from corpus_guard.llm.shared import table

OPEN, AFTER_ROLE, ALSO, CLOSE = "### ", ": ", "<also>", "</turn>\n"
LEARNT = "assistant"
#: Replacements in this order; they are undone in the reverse order.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))


def _replaced(value: str, pairs) -> str:
    for old, new in pairs:
        value = f"replace({value}, {tx.sql_string(old)}, {tx.sql_string(new)})"
    return value


def escaped(value: str, pairs=ESCAPES) -> str:
    """SQL text of the value with control characters replaced."""
    return _replaced(value, pairs)


def unescaped(value: str, pairs=ESCAPES) -> str:
    return _replaced(value, [(new, old) for old, new in reversed(pairs)])


#: Places of the turns that open a block, from 0.
_FIRSTS = """filter(sequence(0, size(turns) - 1),
    i -> i = 0 OR get(turns, i).role <> get(turns, i - 1).role)"""
#: Blocks of neighbouring turns of one role: the marked role, the escaped texts, if they are learnt.
_BLOCKS = f"""transform(firsts, (f, k) -> named_struct(
    'head', concat({tx.sql_string(OPEN)}, {escaped("get(turns, f).role", ROLE_ESCAPES)},
        {tx.sql_string(AFTER_ROLE)}),
    'texts', transform(
        slice(turns, f + 1, coalesce(get(firsts, k + 1), size(turns)) - f), t -> {escaped("t.text")}),
    'learnt', get(turns, f).role = {tx.sql_string(LEARNT)}))"""
_FORMATTED = f"""array_join(transform(blocks, b ->
    concat(b.head, array_join(b.texts, {tx.sql_string(ALSO)}), {tx.sql_string(CLOSE)})), '')"""
#: Characters of every text, and of the marks before and after it.
_LENGTHS = f"""flatten(transform(blocks, b -> transform(b.texts, (t, j) -> named_struct(
    'text', char_length(t),
    'before', IF(j = 0, char_length(b.head), {len(ALSO)}),
    'after', IF(j = size(b.texts) - 1, {len(CLOSE)}, 0),
    'learnt', b.learnt))))"""
_ENDS = tx.running("transform(lengths, x -> x.before + x.text + x.after)")
_LOSS = """transform(
    filter(arrays_zip(lengths, ends), x -> x.lengths.learnt),
    x -> named_struct('start', x.ends - x.lengths.after - x.lengths.text, 'length', x.lengths.text))"""


def formatted(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted and loss (array of start from 0, length) of every conversation.

    Turns are ordered by turn, then role, then text; a null turn comes first. A null text or role
    is empty. Repeated rows are turns of their own. Rows with a null conv_id are one conversation.
    A conversation is one string, so it must fit a task; nothing else is gathered. Further columns
    are ignored. An empty table gives an empty result.
    """
    turn = F.struct(
        F.col("turn").alias("at"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    turns = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    blocks = turns.withColumn("firsts", F.expr(_FIRSTS)).withColumn("blocks", F.expr(_BLOCKS))
    placed = blocks.withColumn("lengths", F.expr(_LENGTHS)).withColumn("ends", F.expr(_ENDS))
    return placed.select("conv_id", F.expr(_FORMATTED).alias("formatted"), F.expr(_LOSS).alias("loss"))


def read_back(rows: DataFrame) -> DataFrame:
    """conv_id, turns (role, text) and loss_text, from ``formatted`` and ``loss`` alone."""
    # the text after the last closing mark is empty
    blocks = f"split(formatted, {tx.sql_string(CLOSE)})"
    head = f"substring_index(b, {tx.sql_string(AFTER_ROLE)}, 1)"
    turns = f"""flatten(transform(slice(blocks, 1, size(blocks) - 1), b -> transform(
        split(substring(b, char_length({head}) + {len(AFTER_ROLE) + 1}), {tx.sql_string(ALSO)}),
        t -> named_struct(
            'role', {unescaped(f"substring({head}, {len(OPEN) + 1})", ROLE_ESCAPES)},
            'text', {unescaped("t")}))))"""
    under = f"array_join(transform(loss, s -> {unescaped('substring(formatted, s.start + 1, s.length)')}), '')"
    return rows.withColumn("blocks", F.expr(blocks)).select(
        "conv_id", "formatted", F.expr(turns).alias("turns"), F.expr(under).alias("loss_text")
    )


#: A conversation whose texts look like the template's own marks.
PROBE = "\\### Assistant: </turn> ok"


def op7(spark, sf_dir: str) -> DataFrame:
    """Digests of what is read back from all formatted conversations and a probe, number -7."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, LEARNT, PROBE)], rows.schema)
    return read_back(formatted(rows.unionAll(probe))).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(
            F.expr("array_join(transform(turns, t -> concat(t.role, '\n', t.text, '\n')), '')"), 256
        ).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_PROBE_SQL = "'" + PROBE + "'"
OP7_SQL = f"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', {_PROBE_SQL}
    UNION ALL SELECT -7, 1, '{LEARNT}', {_PROBE_SQL}
), turns AS (
    SELECT *, row_number() OVER all_turns AS n,
        coalesce(lag(role) OVER all_turns = role, false) AS joins
    FROM rows
    WINDOW all_turns AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id,
    count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = '{LEARNT}'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = '{LEARNT}'), '')) AS loss_sha256,
    sum(length(text) + length(regexp_replace(text, '[^\\\\<#]', '', 'g'))
        + CASE WHEN joins THEN {len(ALSO)}
          ELSE {len(OPEN) + len(AFTER_ROLE) + len(CLOSE)} + length(role)
            + length(regexp_replace(role, '[^\\\\<#:]', '', 'g')) END)::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""
