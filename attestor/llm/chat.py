"""Chat formatting by relational expressions alone: no Python runs on the executors.

Rows of a conversation are collected as structs and sorted by (turn, role, text), nulls first; adjacent rows of the same
role share a block. A block is  <|start|>role<|says|>text<|and|>text<|end|>\\n ; every control string inside a role or text
gets a backslash after its first character and every backslash is doubled, so none can be mistaken and all come back.
The loss mask is a list of (block, start, length) in code points of the block: each assistant text, control strings left out.

Defined results: null text or role is empty text; a null conv_id is a conversation of its own; repeated rows are turns of
their own; an empty table gives an empty result. Other columns are never read. A conversation is one string by nature, so
one task holds one conversation; conversations are spread over all tasks.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import table

START, SAYS, AND, END = "<|start|>", "<|says|>", "<|and|>", "<|end|>\n"
#: Control strings of this and other usual templates, escaped wherever a text holds them. Fixed values.
CONTROL = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        text = F.replace(text, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return text


def _unescaped(sql: str) -> str:
    return rf"regexp_replace({sql}, '(?s)\\\\(.)', '$1')"


def format_chats(rows: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted, loss_mask array<struct<block int, start int, length int>>), a row for each conversation."""
    clean = rows.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    clean = clean.select("conv_id", "turn", "role", "text", escape(F.col("role")).alias("r"), escape(F.col("text")).alias("t"))
    sorted_ = clean.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "r", "t"))).alias("turns"))
    q = lambda s: "'" + s.replace("\\", "\\\\").replace("\n", "\\n") + "'"
    parts = sorted_.select("conv_id", F.expr(f"""transform(turns, (x, i) -> named_struct(
        'loss', x.role = '{LOSS_ROLE}', 'first', i = 0 OR turns[i - 1].role != x.role, 't', x.t,
        'head', IF(i = 0 OR turns[i - 1].role != x.role, concat({q(START)}, x.r, {q(SAYS)}), {q(AND)}),
        'tail', IF(i = size(turns) - 1 OR get(turns, i + 1).role != x.role, {q(END)}, '')))""").alias("parts"))
    # block and place of each part by one pass: an accumulator of (block, length so far, list)
    mask = F.expr("""aggregate(parts, named_struct('block', -1, 'at', 0, 'spans', cast(array() as array<struct<block: int, start: int, length: int>>)),
        (a, x) -> named_struct(
            'block', a.block + int(x.first),
            'at', IF(x.first, 0, a.at) + char_length(x.head) + char_length(x.t) + char_length(x.tail),
            'spans', IF(x.loss, concat(a.spans, array(named_struct('block', a.block + int(x.first), 'start', IF(x.first, 0, a.at) + char_length(x.head), 'length', char_length(x.t)))), a.spans)),
        a -> a.spans)""")
    return parts.select("conv_id", F.array_join(F.flatten(F.expr("transform(parts, x -> array(x.head, x.t, x.tail))")), "").alias("formatted"), mask.alias("loss_mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>, loss_texts array<string>, formatted): what the output says, undone."""
    end = END.replace("|", "\\\\|").replace("\n", "\\n")
    blocks = formatted.withColumn("blocks", F.expr(f"slice(split(formatted, '{end}'), 1, size(split(formatted, '{end}')) - 1)"))
    said = blocks.withColumn("said", F.expr(f"""flatten(transform(blocks, b -> transform(
        split(substring(b, char_length('{START}') + instr(substring(b, char_length('{START}') + 1), '{SAYS}') + char_length('{SAYS}')), '{AND.replace("|", chr(92) * 2 + "|")}'),
        t -> named_struct('role', {_unescaped(f"substring_index(substring(b, char_length('{START}') + 1), '{SAYS}', 1)")}, 'text', {_unescaped("t")}))))"""))
    loss = F.expr(f"transform(loss_mask, m -> {_unescaped('substring(blocks[m.block], m.start + 1, m.length)')})")
    return said.select("conv_id", F.col("said").alias("turns"), loss.alias("loss_texts"), "formatted", F.size("blocks").alias("n_blocks"))


def op3_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.explode(F.array(F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role")))).alias("x"))
    rows = rows.unionByName(extra.select("conv_id", "x.turn", "x.role", F.lit(odd).alias("text")))
    back = read_back(format_chats(rows))
    loss = F.array_join("loss_texts", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(F.flatten(F.expr("transform(turns, x -> array(x.role, '\\n', x.text, '\\n'))")), ""), 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def _sql_escape(col: str) -> str:
    s = rf"replace({col}, '\', '\\')"
    for c in CONTROL:
        s = f"replace({s}, '{c}', '{c[0]}\\{c[1:]}')"
    return s


OP3_SQL = rf"""
WITH a AS (SELECT conv_id, turn, role, text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM a),
o AS (SELECT *, row_number() OVER w AS i, lag(role) OVER w AS before FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
g AS (SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS said,
             coalesce(string_agg(text, '' ORDER BY i) FILTER (role = '{LOSS_ROLE}'), '') AS loss,
             sum(length({_sql_escape("text")}) + CASE WHEN before = role THEN {len(AND)} ELSE {len(START + SAYS + END)} + length({_sql_escape("role")}) END) AS f
      FROM o GROUP BY conv_id)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(f AS BIGINT) AS formatted_chars FROM g
"""
