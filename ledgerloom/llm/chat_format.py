"""Chat formatting by incremental black-box rendering.

A template is any function from turns to text. Successive prefixes of a conversation are rendered; what the output of a
prefix has more than the output before is the span of its last turn. If an output does not start with the one before, the
template rewrites history, and the turn is marked. Nothing is assumed about how the template works inside.

Rows are dealt by conversation, sorted, and rendered turn by turn. A long conversation is rendered in windows: after
``window_turns`` turns or ``window_chars`` characters the prefix is cut to its first turn and the last one before the
window, so time stays in proportion to the rows. With a template that is known to render every turn alone, conversations
are streamed and a task holds one window. With any other a task holds a conversation: what the windows gave is compared
with whole renderings of its first 1, 2, 4, ... turns and of all; if one differs, or a window rewrites history, the
conversation is rendered again by whole prefixes, in time that grows with the square of its length.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
Template = Callable[[list[tuple[str, str]]], str]
MARK = re.compile(r"<(\\*)\|")
ESCAPED = re.compile(r"<\\(\\*)\|")
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
SCHEMA = "conv_id bigint, turn bigint, n bigint, role string, is_loss boolean, rendered string, span_start bigint, span_end bigint, loss_start bigint, loss_end bigint, rewrites_history boolean"


def escape(text: str) -> str:
    """Put a backslash between every ``<``, its backslashes and ``|``: no control string is left, and it can be undone."""
    return MARK.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """As :func:`escape`; line ends become ``<|nl|>``, which no escaped text holds."""
    return escape(role).replace("\n", "<|nl|>")


def unescape_role(role: str) -> str:
    return unescape(role.replace("<|nl|>", "\n"))


def marked_turns(turns: list[tuple[str, str]]) -> str:
    """The template of the query: every turn between control strings, texts escaped."""
    return "".join(f"{START}{escape_role(role)}\n{escape(text)}{END}\n" for role, text in turns)


def render_turns(
    df: DataFrame, template: Template = marked_turns, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    loss_roles: tuple[str, ...] = ("assistant",), escaped: Callable[[str], str] = escape, window_turns: int = 64, window_chars: int = 1 << 20,
    turns_alone: bool | None = None,
) -> DataFrame:
    """One row for each turn: its rendered text, span in the conversation's output, loss span and rewriting mark.

    Rows are ordered by turn, then role and text; NULLs come first, equal rows stay separate turns. NULL role and text
    count as empty. Rows with a NULL conversation form one conversation. ``span_start`` and ``span_end`` count characters
    of the whole output. The loss span is where the turn's escaped text stands in its span, for the loss roles: the place at
    which a character strange to the output appears when the turn is rendered once more with it for a text, so equal
    characters beside the text do not shift it. Both ends are NULL where the template rewrites history, and where the
    escaped text does not stand from there on (a template that trims or changes it). ``turns_alone`` says that the template renders every turn by itself, as the
    marked template does; windows are then not checked.
    """
    if turns_alone is None:
        turns_alone = template is marked_turns
    rows = df.select(
        F.col(conv).cast("bigint").alias("conv"), F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    ).repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")

    def mark_outside(text: str) -> str:
        """A character of the private use area that the text does not hold."""
        return next(c for c in map(chr, itertools.chain(range(0xE000, 0xF900), range(0xF0000, 0x10FFFE))) if c not in text)

    def common(a: str, b: str) -> int:
        low, high = 0, min(len(a), len(b))
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
        return low

    def formatted(said, windows):
        """Rows of a conversation's turns, and whether the prefix was cut before each."""
        n, done, turns, cut = 0, 0, [], False
        before = template(turns)
        for c, t, who, what in said:
            if windows and turns and (len(turns) >= window_turns or sum(len(x) for _, x in turns[1:]) > window_chars):
                cut = cut or len(turns) > 2
                turns = [turns[0], turns[-1]] if len(turns) > 1 else turns
                before = template(turns)
            turns = [*turns, (who, what)]
            now = template(turns)
            rewrites = not now.startswith(before)
            start = common(before, now) if rewrites else len(before)
            piece = now[start:]
            loss = who in loss_roles and not rewrites
            at = end = None
            if loss:
                # the text stands where a character that no rendering so far holds appears in its place
                body = escaped(what)
                mark = mark_outside(now)
                at = piece.find(body, max(template([*turns[:-1], (who, mark)]).find(mark) - start, 0))
                at, end = (at, at + len(body)) if at >= 0 else (None, None)
            yield (c, t, n, who, loss, piece, done, done + len(piece), done + at if at is not None else None, done + end if end is not None else None, rewrites), cut
            n, done, before = n + 1, done + len(piece), now

    def agrees(said, found):
        """Whether the rows are those of whole renderings, looked at after 1, 2, 4, ... turns and the last."""
        turns, text, at, n = [(who, what) for _, _, who, what in said], [template([])], 0, 1
        while at < len(turns):
            text = ["".join([*text, *(r[5] for r in found[at:n])])]
            if any(r[-1] for r in found[at:n]) or template(turns[:n]) != text[0]:
                return False
            at, n = n, min(2 * n, len(turns))
        return True

    def conversation(said):
        if turns_alone:
            yield from (row for row, _ in formatted(said, True))
            return
        said = list(said)
        found = list(formatted(said, True))
        rows = [row for row, _ in found]
        if found[-1][1] and not agrees(said, rows):
            rows = (row for row, _ in formatted(said, False))
        yield from rows

    def task(batches):
        said = (r for batch in batches for r in zip(*(batch.column(x).to_pylist() for x in ("conv", "turn", "role", "text"))))
        found = (row for _, own in itertools.groupby(said, key=lambda r: r[0]) for row in conversation(own))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), *[pa.int64()] * 4, pa.bool_()]
        out, size = [], 0
        for row in itertools.chain(found, [None]):
            if row:
                out.append(row)
                size += len(row[5])
            if out and (row is None or len(out) >= 10_000 or size > 4 << 20):
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], [f.split()[0] for f in SCHEMA.split(", ")])
                out, size = [], 0

    return rows.mapInArrow(task, SCHEMA)


def read_back(rendered: DataFrame) -> DataFrame:
    """Digests of conversations, read from the rendered text of :func:`render_turns` with the marked template.

    Rows must come as :func:`render_turns` leaves them: a conversation in one partition, in order. Only running digests of
    one conversation are held.
    """

    def task(batches):
        state, out = None, []

        def close():
            conv, n, turns, chars, loss, size, rewrites = state
            out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size, rewrites))

        for batch in batches:
            names = ("conv_id", "rendered", "span_start", "loss_start", "loss_end", "rewrites_history")
            for conv, text, start, loss_start, loss_end, rewrites in zip(*(batch.column(x).to_pylist() for x in names)):
                if state is None or state[0] != conv:
                    if state:
                        close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for m in TURN.finditer(text):
                    state[1] += 1
                    state[2].update(f"{unescape_role(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "surrogatepass"))
                if loss_start is not None:
                    plain = unescape(text[loss_start - start : loss_end - start])
                    state[3] += len(plain)
                    state[4].update(plain.encode("utf-8", "surrogatepass"))
                state[5] += len(text)
                state[6] += rewrites
            yield flush(out)
        if state:
            close()
            yield flush(out)

    def flush(out):
        columns = list(zip(*out)) if out else [()] * 7
        out.clear()
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_rewrites"])

    return rendered.mapInArrow(task, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_rewrites bigint")
