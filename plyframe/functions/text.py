"""Column expressions over replies and prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------
MARKER = "best move:"
SAN_CORE = "O-O-O|O-O|[KQRNB]?[a-h]?[1-8]?x?[a-h][1-8](?:=[QRNB])?[+#]?"
# ----------------------------------------------------------------------------------------

# Word characters and white space in the Unicode sense, spelled out so that the result does not
# depend on the Java release.
WORD = r"[\p{L}\p{N}_]"
WHITE = r"[\s\x1c-\x1f\x85\p{Z}]"
_BOUNDARY = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
# A move starts with a word character, so the boundary before it is a look back.
_START = f"(?<!{WORD})"
SAN_TOKEN = f"{_START}({SAN_CORE}){_BOUNDARY}"


def strip(text: Column) -> Column:
    """Drop white space of any kind at both ends."""
    return F.regexp_replace(text, rf"^{WHITE}+|{WHITE}+\z", "")


def has_marker(text: Column) -> Column:
    return F.contains(F.lower(text), F.lit(MARKER))


def marker_window(text: Column) -> Column:
    """Text after the last marker, stripped; empty if there is no marker."""
    return strip(F.regexp_extract(text, rf"(?is)^.*{MARKER}(.*)\z", 1))


def first_san(text: Column) -> Column:
    """First token that looks like a move, '' if there is none."""
    return F.regexp_extract(text, SAN_TOKEN, 1)


def strip_check_suffix(text: Column) -> Column:
    return F.regexp_replace(strip(text), r"[+#]+\z", "")


def candidate(reply: Column, use_marker: bool = True) -> Column:
    """The move text a reply proposes, without check marks."""
    return strip_check_suffix(first_san(marker_window(reply) if use_marker else reply))


def truncate_after_san(text: Column, after_marker: bool) -> Column:
    """Reply up to and including its first move (after the first marker), whole if there is none."""
    lead = rf"(?:(?i:.*?{MARKER}).*?)" if after_marker else "(?:.*?)"
    cut = F.regexp_extract(text, rf"(?s)^({lead}{_START}(?:{SAN_CORE}){_BOUNDARY})", 1)
    return F.when(cut == "", text).otherwise(cut)


LONGEST_SAN = 9  # a piece's capture with both coordinates, promotion and check


def stop_index(pieces: Column, after_marker: bool) -> Column:
    """Number of generated pieces after which a reply stops: the first prefix in which the rule
    holds, null if it never does. `pieces` is the array of decoded token texts.

    A move that a piece completes begins at most LONGEST_SAN characters before the piece, so only
    these, one more to look back at, and the piece are searched: the work follows the reply's length.
    """
    reach = LONGEST_SAN + 1

    def grow(state: Column, piece: Column) -> Column:
        text = F.concat(state["tail"], piece)
        marker = F.regexp_instr(text, F.lit(f"(?i){MARKER}"))
        seen = state["seen"] | (marker > 0)
        text = F.when(state["seen"] | (marker == 0), text).otherwise(F.substr(text, marker + len(MARKER)))
        found = seen & F.when(state["cut"], F.rlike(text, F.lit(f"(?s)^.+?{SAN_TOKEN}"))).otherwise(F.rlike(text, F.lit(SAN_TOKEN)))
        n = state["n"] + 1
        return F.when(state["stop"].isNotNull(), state).otherwise(F.struct(
            F.right(text, F.when(seen, reach).otherwise(len(MARKER) - 1)).alias("tail"),
            (seen & (state["cut"] | (F.length(text) > reach))).alias("cut"),
            seen.alias("seen"), n.alias("n"), F.when(found, n).alias("stop"),
        ))

    start = F.struct(F.lit("").alias("tail"), F.lit(False).alias("cut"), F.lit(not after_marker).alias("seen"),
                     F.lit(0).alias("n"), F.lit(None).cast("int").alias("stop"))
    return F.aggregate(pieces, start, grow)["stop"]


def sanitize_model_id(model: Column) -> Column:
    return F.translate(model, "/:", "__")


def is_true(flag: Column) -> Column:
    """Report rule: only the word true counts."""
    return F.coalesce(F.lower(strip(flag)) == "true", F.lit(False))


def is_not_false(flag: Column) -> Column:
    """Viewer rule for legality: everything but the word false counts."""
    return F.coalesce(F.lower(strip(flag)) != "false", F.lit(True))


def eval_bucket(cp: Column, mate: Column, white_to_move: Column, margin: int = 100) -> Column:
    """winning / losing / equal for the side to move; engine scores are from White's side."""
    sign = F.when(white_to_move, 1).otherwise(-1)
    score = sign * F.coalesce(F.when(mate > 0, margin + 1).when(mate <= 0, -margin - 1), cp)
    return F.when(score > margin, "winning").when(score < -margin, "losing").when(score.isNotNull(), "equal")


def two_line_check(reply: Column, max_words: int = 15) -> Column:
    """Whether a reply has a reasoning line of at most `max_words` words and a line with a move."""
    reason = F.regexp_extract(reply, r"(?im)^[ \t]*my reasoning:[ \t]*(.*)$", 1)
    words = F.size(F.filter(F.split(strip(reason), rf"{WHITE}+"), lambda w: w != ""))
    return F.struct(
        F.rlike(reply, F.lit(r"(?im)^[ \t]*my reasoning:")).alias("has_reasoning"),
        words.alias("reasoning_words"),
        F.rlike(reply, F.lit(r"(?im)^[ \t]*best move:[ \t]*\S")).alias("has_move_line"),
        (F.rlike(reply, F.lit(r"(?im)^[ \t]*my reasoning:")) & (words <= max_words)
         & F.rlike(reply, F.lit(r"(?im)^[ \t]*best move:[ \t]*\S"))).alias("well_formed"),
    )


def tag_text(reply: Column, tag: str) -> Column:
    """Content of the first <tag>...</tag>, '' if absent."""
    return F.regexp_extract(reply, rf"(?s)<{tag}>(.*?)</{tag}>", 1)


def moves_in(text: Column) -> Column:
    """All move-like tokens of a text, in order."""
    return F.regexp_extract_all(text, F.lit(SAN_TOKEN), F.lit(1))
