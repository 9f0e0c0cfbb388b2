"""Chat messages and prompt text for a position; one row in, one row out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plyframe.functions.fen import board_text, side_to_move
from plyframe.functions.text import eval_bucket
from plyframe.operators.moves import legal_moves
from plyframe.operators.san import with_san
from plyframe.plans.scratch import written

# --- fixed values: prompt texts -----------------------------------------------------------
TWO_LINES = (
    "You are a chess assistant. Reply with exactly two lines:\n"
    "My reasoning: <15 words max>\n"
    "Best Move: <legal SAN only>"
)
MOVE_ONLY = (
    "You are a chess assistant. Given a chess position and side to move, "
    "respond with the best legal move in standard algebraic notation (SAN). "
    "Do not provide any reasoning."
)
MOVE_ONLY_PLAIN = (
    "You are a chess assistant. Given a chess position and side to move, "
    "respond with the best legal move in SAN."
)
REASONING_REPLY = "My reasoning: Strong tactical position.\nBest Move: "
BOARD_IS, CHOICE_FOR, CHOICE_IS = "the board position is FEN: ", "the best move for ", " is "
# ------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class PromptStyle:
    """What differs between the two prompt variants."""

    system: str
    plain: str
    reply_prefix: str


REASONED = PromptStyle(TWO_LINES, TWO_LINES, REASONING_REPLY)
SAN_ONLY = PromptStyle(MOVE_ONLY, MOVE_ONLY_PLAIN, "")


@dataclass(frozen=True)
class ChatTemplate:
    """Texts around one message, and the text that asks for the next one."""

    before_role: str = "<|im_start|>"
    after_role: str = "\n"
    after_message: str = "<|im_end|>\n"
    generation: str = "<|im_start|>assistant\n"


def position_text(fen: Column) -> Column:
    return F.concat(F.lit("Side to move: "), side_to_move(fen), F.lit("\nBoard:\n"), board_text(fen))


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat_messages(fen: Column, best_move: Column | None = None, style: PromptStyle = REASONED) -> Column:
    """System and user message, and the assistant's answer if `best_move` is given."""
    messages = [_message("system", F.lit(style.system)), _message("user", position_text(fen))]
    if best_move is not None:
        messages.append(_message("assistant", F.concat(F.lit(style.reply_prefix), best_move)))
    return F.array(*messages)


def apply_template(messages: Column, template: ChatTemplate = ChatTemplate(), ask: bool = False) -> Column:
    """One text from an array of (role, content); `ask` adds the generation prompt."""
    text = F.array_join(F.transform(messages, lambda m: F.concat(
        F.lit(template.before_role), m["role"], F.lit(template.after_role), m["content"], F.lit(template.after_message),
    )), "")
    return F.concat(text, F.lit(template.generation)) if ask else text


def chat_text(fen: Column, best_move: Column | None = None, style: PromptStyle = REASONED,
              template: ChatTemplate = ChatTemplate()) -> Column:
    """The template over the messages of `chat_messages`, joined directly: the board is built once. Without `best_move`
    the text asks for it."""
    said = [("system", [F.lit(style.system)]), ("user", [position_text(fen)])]
    if best_move is not None:
        said.append(("assistant", [F.lit(style.reply_prefix), best_move]))
    parts = [x for role, content in said for x in (
        F.lit(template.before_role + role + template.after_role), *content, F.lit(template.after_message))]
    return F.concat(*parts, *([F.lit(template.generation)] if best_move is None else []))


def plain_prompt(fen: Column, best_move: Column | None = None, style: PromptStyle = REASONED) -> Column:
    """Text for tokenizers without a chat template."""
    text = F.concat(F.lit(style.plain + "\n\n"), position_text(fen), F.lit("\nAnswer:\n"))
    return text if best_move is None else F.concat(text, best_move)


def prompt_or_plain(has_template: Column, fen: Column, best_move: Column | None = None,
                    style: PromptStyle = SAN_ONLY, template: ChatTemplate = ChatTemplate()) -> Column:
    """Template text where one is available, else the plain prompt."""
    return F.when(has_template, chat_text(fen, best_move, style, template)).otherwise(plain_prompt(fen, best_move, style))


def legal_san_list(positions: DataFrame, fen: str = "fen") -> DataFrame:
    """The rows with all legal moves of their position as sorted SAN, bounded by the rules of the game; a position without
    moves gives no row. Moves carry the number of their row only, as each is sorted with what it carries; rows are written
    with their numbers and joined with the lists."""
    rows = written(positions.withColumn("_row", F.monotonically_increasing_id()))
    dealt = rows.select("_row", fen).repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)  # small rows, much work
    moves = with_san(legal_moves(dealt, fen, keep_position=True)).select("_row", "san")
    lists = moves.groupBy("_row").agg(F.array_join(F.array_sort(F.collect_list("san")), ", ").alias("legal_san"))
    return rows.join(lists, "_row").drop("_row")


def tagged_prompt(samples: DataFrame, key: str) -> DataFrame:
    """Five-tag prompt. `samples` has key, fen, best_move, top_moves, cp and mate."""
    rows = legal_san_list(samples.select(key, "fen", "best_move", "top_moves", "cp", "mate"))
    side = side_to_move(F.col("fen"))
    bucket = eval_bucket(F.col("cp"), F.col("mate"), side == "White")
    text = F.concat(
        F.lit("<board_position>" + BOARD_IS), F.col("fen"), F.lit("</board_position>\n<evaluate>"),
        F.coalesce(bucket, F.lit("unknown")), F.lit("</evaluate>\n<perceive>"), F.col("legal_san"),
        F.lit("</perceive>\n<predict>"), F.array_join("top_moves", ", "), F.lit("</predict>\n<choose>" + CHOICE_FOR),
        side, F.lit(CHOICE_IS), F.col("best_move"), F.lit("</choose>"),
    )
    return rows.select(key, text.alias("prompt"))
