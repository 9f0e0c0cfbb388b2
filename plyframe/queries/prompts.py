"""Queries over prompts, tokens and paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from plyframe.functions import fen as fenf
from plyframe.operators import prompts as pr
from plyframe.operators import samples, tokens, viewer
from plyframe.plans import ordinals, ranks
from plyframe.plans.scratch import scratch_folder
from plyframe.queries import chess_sql as cs
from plyframe.queries import fixtures as fx
from plyframe.queries.registry import query

_EXPAND = "split_part(fen, ' ', 1)"
for _n in range(1, 9):
    _EXPAND = f"replace({_EXPAND}, '{_n}', '{'.' * _n}')"
_RANKS = " || ".join(
    f"'  -----------------' || chr(10) || '{r} ' || regexp_replace(translate(split_part({_EXPAND}, '/', {9 - r}), "
    f"'PNBRQKpnbrqk.', '♙♘♗♖♕♔♟♞♝♜♛♚·'), '(.)', '|\\1', 'g') || '|' || chr(10)" for r in range(8, 0, -1)
)
_SIDE = "CASE WHEN split_part(fen, ' ', 2) = 'b' THEN 'Black' ELSE 'White' END"
# Positions a rules library accepts, with side and diagram.
_SHOWN = fx.SQL_POSITIONS + f""", diagrams AS (
  SELECT k, {_SIDE} AS side, {_RANKS} || '  -----------------' || chr(10) || '   a b c d e f g h' AS diagram FROM fx_fens WHERE k < 10),
shown AS (SELECT p.*, d.side, d.diagram, 'Side to move: ' || side || chr(10) || 'Board:' || chr(10) || diagram AS asks
  FROM fx_positions p JOIN diagrams d ON d.k = p.k),
lines AS (SELECT 'You are a chess assistant. Reply with exactly two lines:' || chr(10) || 'My reasoning: <15 words max>'
  || chr(10) || 'Best Move: <legal SAN only>' AS two,
  'You are a chess assistant. Given a chess position and side to move, respond with the best legal move in standard algebraic notation (SAN). Do not provide any reasoning.' AS only_san,
  'You are a chess assistant. Given a chess position and side to move, respond with the best legal move in SAN.' AS plain)"""


def _shown(spark, sf, *more):
    return fx.positions(spark, sf, *more).where(fenf.fen_valid_strict(F.col("fen")))


@query("board_text", f"WITH {_SHOWN} SELECT pos_id, diagram FROM shown")
def board_text(spark, sf):
    return _shown(spark, sf).select("pos_id", fenf.board_text(F.col("fen")).alias("diagram"))


_ANSWERED = _SHOWN + ", " + fx.SQL_MOVES + """,
answered AS (SELECT s.*, m.san FROM shown s JOIN fx_moves m ON m.k = s.k AND m.j = (s.pos_id // 12) % 6 WHERE m.san IS NOT NULL)"""


def _answered(spark, sf):
    return _shown(spark, sf, "sans").select(
        "pos_id", "fen", F.expr("sans[CAST((pos_id DIV 12) % 6 AS INT)]").alias("san")).where("san IS NOT NULL")


@query("chat_messages", f"""WITH {_ANSWERED}, styled AS (
  SELECT pos_id, style, asks, san, CASE style WHEN 'reasoned' THEN two ELSE only_san END AS sys,
    CASE style WHEN 'reasoned' THEN 'My reasoning: Strong tactical position.' || chr(10) || 'Best Move: ' ELSE '' END AS pre
  FROM answered CROSS JOIN lines CROSS JOIN (VALUES ('reasoned'), ('san_only')) AS st(style))
SELECT pos_id, style, 0 AS pos, 'system' AS role, sys AS content FROM styled
UNION ALL SELECT pos_id, style, 1, 'user', asks FROM styled UNION ALL SELECT pos_id, style, 2, 'assistant', pre || san FROM styled""")
def chat_messages(spark, sf):
    styles = {"reasoned": pr.REASONED, "san_only": pr.SAN_ONLY}
    # Columns of one projection, where the board's text is made once; inside explode() each naming would make it again.
    rows = _answered(spark, sf).select("pos_id", *(pr.chat_messages(F.col("fen"), F.col("san"), s).alias(name) for name, s in styles.items()))
    both = F.array(*(F.struct(F.lit(name).alias("style"), F.col(name).alias("messages")) for name in styles))
    styled = rows.select("pos_id", F.explode(both).alias("s")).select("pos_id", "s.style", F.posexplode("s.messages").alias("pos", "m"))
    return styled.select("pos_id", "style", "pos", "m.role", "m.content")


def _turn(role: str, content: str) -> str:
    return f"'<|im_start|>{role}' || chr(10) || {content} || '<|im_end|>' || chr(10)"


_REPLY = "'My reasoning: Strong tactical position.' || chr(10) || 'Best Move: ' || san"


@query("chat_template", f"""WITH {_ANSWERED}
SELECT pos_id, {_turn('system', 'two')} || {_turn('user', 'asks')} || {_turn('assistant', _REPLY)} AS text FROM answered CROSS JOIN lines""")
def chat_template(spark, sf):
    return _answered(spark, sf).select("pos_id", pr.chat_text(F.col("fen"), F.col("san")).alias("text"))


@query("prompt_fallback", f"""WITH {_ANSWERED} SELECT pos_id, CASE WHEN pos_id % 2 = 0
  THEN {_turn('system', 'only_san')} || {_turn('user', 'asks')} || {_turn('assistant', 'san')}
  ELSE plain || chr(10) || chr(10) || asks || chr(10) || 'Answer:' || chr(10) || san END AS text FROM answered CROSS JOIN lines""")
def prompt_fallback(spark, sf):
    text = pr.prompt_or_plain(F.col("pos_id") % 2 == 0, F.col("fen"), F.col("san"))
    return _answered(spark, sf).select("pos_id", text.alias("text"))


@query("inference_prompt", f"""WITH {_SHOWN} SELECT pos_id,
  {_turn('system', 'two')} || {_turn('user', 'asks')} || '<|im_start|>assistant' || chr(10) AS chat,
  two || chr(10) || chr(10) || asks || chr(10) || 'Answer:' || chr(10) AS plain_text FROM shown CROSS JOIN lines""")
def inference_prompt(spark, sf):
    return _shown(spark, sf).select(
        "pos_id", pr.chat_text(F.col("fen")).alias("chat"),
        pr.plain_prompt(F.col("fen")).alias("plain_text"))


@query("inference_prompt_san_only", f"""WITH {_SHOWN} SELECT pos_id, CASE WHEN pos_id % 2 = 0
  THEN {_turn('system', 'only_san')} || {_turn('user', 'asks')} || '<|im_start|>assistant' || chr(10)
  ELSE plain || chr(10) || chr(10) || asks || chr(10) || 'Answer:' || chr(10) END AS text FROM shown CROSS JOIN lines""")
def inference_prompt_san_only(spark, sf):
    return _shown(spark, sf).select("pos_id", pr.prompt_or_plain(F.col("pos_id") % 2 == 0, F.col("fen")).alias("text"))


@query("chat_template_turns", """SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn)
  || '<|im_start|>assistant' || chr(10) AS text FROM conversations GROUP BY conv_id""")
def chat_template_turns(spark, sf):
    turns = fx.table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages"))
    return turns.select("conv_id", pr.apply_template(F.col("messages"), ask=True).alias("text"))


@query("xml_prompt", f"""WITH {cs.SAN}, {fx.SQL_TOP.replace(fx.SQL_FENS + ',', '', 1)},
lists AS (SELECT k, string_agg(san, ', ' ORDER BY san) AS legal_san FROM a_san GROUP BY k)
SELECT pos_id, concat('<board_position>the board position is FEN: ', s.fen, '</board_position>', chr(10), '<evaluate>',
  CASE WHEN score > 100 THEN 'winning' WHEN score < -100 THEN 'losing' ELSE 'equal' END, '</evaluate>', chr(10),
  '<perceive>', legal_san, '</perceive>', chr(10), '<predict>', replace(top_moves, ',', ', '), '</predict>', chr(10),
  '<choose>the best move for ', side, ' is ', best_move, '</choose>') AS prompt
FROM (SELECT *, {_SIDE} AS side, (pos_id % 600 - 300) * CASE WHEN {_SIDE} = 'Black' THEN -1 ELSE 1 END AS score FROM fx_samples) s
JOIN lists l ON l.k = s.k""")
def xml_prompt(spark, sf):
    valid = samples.valid_samples(fx.documents(spark, sf), "pos_id").withColumns({
        "cp": F.expr("CAST(pos_id % 600 - 300 AS INT)"), "mate": F.lit(None).cast("int")})
    return pr.tagged_prompt(valid, "pos_id")


_LENGTH = 256
_WORDS = r"list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')"
_VOCAB = f"""counts AS (SELECT word, count(*) AS n FROM (SELECT unnest({_WORDS}) AS word FROM documents) GROUP BY word),
vocab AS (SELECT word, n, row_number() OVER (ORDER BY n DESC, word) + 1 AS token_id FROM counts)"""
_TOKENS = f"""{_VOCAB}, spoken AS (SELECT conv_id, turn, {_WORDS}[1:{_LENGTH}] AS ws FROM conversations),
tok AS (SELECT conv_id, turn, pos, coalesce(v.token_id, 1) AS id
  FROM (SELECT conv_id, turn, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM spoken) LEFT JOIN vocab v USING (word)),
joined AS (SELECT s.conv_id, s.turn, len(ws) AS used, coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos), '') AS ids
  FROM spoken s LEFT JOIN tok t ON t.conv_id = s.conv_id AND t.turn = s.turn GROUP BY ALL)"""


def _padded(fill: str, text: str = "ids") -> str:
    return f"trim({text} || repeat(',{fill}', CAST({_LENGTH} - used AS INT)), ',')"


@query("vocab_build", f"WITH {_VOCAB} SELECT word, n, token_id FROM vocab")
def vocab_build(spark, sf):
    return tokens.vocabulary(fx.table(spark, sf, "documents"), "text")


def _tokenized(spark, sf):
    vocab = tokens.vocabulary(fx.table(spark, sf, "documents"), "text")
    return tokens.tokenize_pad(fx.table(spark, sf, "conversations"), ["conv_id", "turn"], "text", vocab, _LENGTH)


@query("tokenize_pad", f"""WITH {_TOKENS} SELECT conv_id, turn, {_padded('0')} AS input_ids,
  trim(repeat(',1', CAST(used AS INT)) || repeat(',0', CAST({_LENGTH} - used AS INT)), ',') AS attention_mask FROM joined""")
def tokenize_pad(spark, sf):
    return _tokenized(spark, sf).select(
        "conv_id", "turn", F.array_join("input_ids", ",").alias("input_ids"),
        F.array_join("attention_mask", ",").alias("attention_mask"))


@query("label_mask", f"WITH {_TOKENS} SELECT conv_id, turn, {_padded('-100')} AS labels FROM joined")
def label_mask(spark, sf):
    return _tokenized(spark, sf).select("conv_id", "turn", F.array_join("labels", ",").alias("labels"))


@query("encode_with_batches", f"""SELECT conv_id, turn, CAST(len({_WORDS}[1:{_LENGTH}]) AS BIGINT) AS words,
  list_sum(list_transform({_WORDS}[1:{_LENGTH}], lambda w: 1 + length(w))) AS id_sum FROM conversations""")
def encode_with_batches(spark, sf):
    def encode(texts):
        import re

        return [[1 + len(w) for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w] for text in texts]

    talks = fx.table(spark, sf, "conversations")
    ids = tokens.encode_with(talks, ["conv_id", "turn"], "text", encode, _LENGTH)
    total = F.aggregate("input_ids", F.lit(0).cast("bigint"), lambda a, x: a + x)
    used = F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return ids.select("conv_id", "turn", total.alias("id_sum"), used.alias("words"))


@query("cyclic_next", f"""WITH {fx.SQL_RESULTS} SELECT model, id,
  coalesce(lead(id) OVER (PARTITION BY model ORDER BY id), first_value(id) OVER (PARTITION BY model ORDER BY id)) AS next FROM fx_results""")
def cyclic_next(spark, sf):
    return ordinals.cyclic_next(fx.results(spark, sf).select("model", "id"), "id", ["model"])


@query("entry_by_index", f"""WITH {fx.SQL_REPLIES}, numbered AS (
  SELECT model, id, fen, row_number() OVER (PARTITION BY model ORDER BY id) - 1 AS ord FROM fx_replies)
SELECT model, id, fen, true AS valid, concat('It is ', {_SIDE}, '''s move. Select a piece to play your move.') AS message
FROM numbered WHERE ord = 8""")
def entry_by_index(spark, sf):
    return viewer.entry_by_index(fx.replies(spark, sf).drop("k", "full_reply"), 8, "id", ["model"])


@query("entry_by_rank", f"""WITH {fx.SQL_REPLIES}, numbered AS (
  SELECT model, id, fen, full_reply, row_number() OVER (PARTITION BY model ORDER BY id) - 1 AS ord FROM fx_replies)
SELECT model, id, fen, full_reply FROM numbered WHERE ord = 700""")
def entry_by_rank(spark, sf):
    folder = scratch_folder(spark)
    ranks.write_rank_index(fx.replies(spark, sf).drop("k"), folder, "id", ["model"], bucket_rows=4096)
    return ranks.entries_at(spark, folder, 700, "id", ["model"]).select("model", "id", "fen", "full_reply")
