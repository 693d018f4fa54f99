"""Documents that arrive in pieces: the stages over a stream, with the open tail as state.

A document's pieces come in order under one key.  Each step holds back as many bytes as a
match could still need, so that the pieces' outputs together equal the output of the whole
text.  The last piece (``last`` true) lets the tail go.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import names
from ..functions.scanner import to_bytes
from ..plans.redaction import EVENT, Options, stages

#: Bytes that a tail keeps back for matches whose length has no bound of its own.
TAIL = 256


def tail_bytes(options: Options) -> int:
    """Bytes that must wait: the longest name, a near match's window, or an SSN."""
    known = [to_bytes(n) for n in options.names]
    need = 10 if options.ssn else 0
    if known and options.entity_mask:
        need = max(need, max(map(len, known)))
    if known and options.fuzzy:
        need = max(need, min((names.Fuzzy(known, options.fuzzy_threshold).most_words + 1) * 20, TAIL))
    if (options.patterns and options.flags.any()) or options.context:
        need = max(need, TAIL)
    return need


def cut_at(data: str, wait: int) -> int:
    """Where a buffer may be cut: the last blank before the bytes that wait, or 0."""
    limit = len(data) - wait
    return max(data.rfind(" ", 0, limit), data.rfind("\n", 0, limit)) + 1 if limit > 0 else 0


class Pieces:
    """The stages over pieces of one text."""

    def __init__(self, run: Callable[[str], str], wait: int, tail: str = ""):
        self.run, self.wait, self.tail = run, wait, tail

    def take(self, piece: str, last: bool = False) -> str:
        """The input that is settled by now: the open tail stays behind.

        A cut is safe only if no match lies across it: then both sides keep their matches.
        Cuts are tried at blanks that lie back by doubling distances, so that a long tail
        costs a number of runs that grows with the logarithm of its length.
        """
        data = self.tail + piece
        if last:
            self.tail = ""
            return data
        at, back = cut_at(data, self.wait), 32
        whole = self.run(data) if at else ""
        while at:
            head, rest = data[:at], data[at:]
            if self.run(head) + self.run(rest) == whole:
                self.tail = rest
                return head
            at, back = cut_at(data[: max(at - back, 0)], 0), 2 * back
        self.tail = data
        return ""

    def feed(self, piece: str, last: bool = False) -> str:
        """What can be told of the output so far."""
        return self.run(self.take(piece, last))


class _Redactor(StatefulProcessor):
    """Tails of open texts, with the place and number of what was last given out."""

    def __init__(self, options: Options, timeout_ms: int | None = None):
        self.options, self.timeout_ms = options, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open(handle)
        self.full, self.wait = stages(self.options), tail_bytes(self.options)

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("tail", "tail binary, base long, seq long")

    def held(self) -> tuple[str, int, int]:
        """The open tail, its place in the text, and the number of the last piece."""
        if not self.state.exists():
            return "", 0, -1
        tail, base, seq = self.state.get()
        return bytes(tail).decode("latin-1"), base, seq

    def row(self, key, seq: int, head: str, base: int, last: bool) -> tuple:
        """One row of output; places of events count from the start of the text."""
        output, events = self.full(head)
        moved = [e | {"offset": e["offset"] + base} for e in events]
        # a piece may end inside a character: only whole texts are decoded
        return key[0], seq, output.encode("latin-1").decode("utf-8", "replace"), last, moved

    def timer(self, now: int | None) -> None:
        """Let the key's time-out start anew, or end."""
        if self.timeout_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if now is not None:
                self.handle.registerTimer(now + self.timeout_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tail, base, newest = self.held()
        pieces = Pieces(lambda text: self.full(text)[0], self.wait, tail)
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        out, ended = [], False
        for seq, text, last in zip(batch["seq"], batch["text"], batch["last"], strict=True):
            ended, newest = bool(last), max(newest, int(seq))
            head = pieces.take(to_bytes(text or ""), ended)
            out.append(self.row(key, seq, head, base, ended))
            base = 0 if ended else base + len(head)
        if ended:
            self.state.clear()
            self.timer(None)
        else:
            self.state.update((pieces.tail.encode("latin-1"), base, newest))
            self.timer(timerValues.getCurrentProcessingTimeInMs() if self.timeout_ms is not None else None)
        yield pd.DataFrame(out, columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        tail, base, seq = self.held()
        self.state.clear()
        yield pd.DataFrame([self.row(key, seq, tail, base, True)], columns=COLUMNS)

    def close(self) -> None:
        pass


COLUMNS = ["doc_id", "seq", "output", "last", "events"]
_OUTPUT = f"doc_id string, seq long, output string, last boolean, events array<struct<{EVENT}>>"


def _stream(pieces: DataFrame, processor: StatefulProcessor, mode: str) -> DataFrame:
    time = "None" if processor.timeout_ms is None else "ProcessingTime"
    return pieces.groupBy("doc_id").transformWithStateInPandas(processor, _OUTPUT, mode, time)


def redact_stream(pieces: DataFrame, options: Options, mode: str = "append", timeout_ms: int | None = None) -> DataFrame:
    """(doc_id, seq, output, last, events) of a stream of pieces (doc_id string, seq, text, last).

    ``events`` are the audit events of the row's output; a stage's places are bytes of what
    the stage before wrote for this row's input, moved by where that input starts.  A text
    whose next piece does not come within ``timeout_ms`` is ended: its tail is given out
    under the last piece's number with ``last`` true and its state is freed; pieces that
    come later start a new text.
    """
    return _stream(pieces, _Redactor(options, timeout_ms), mode)


class _Unmasker(_Redactor):
    def __init__(self, known: list[str], groups: list[int] | None, timeout_ms: int | None = None):
        self.known, self.groups, self.timeout_ms = known, groups, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open(handle)
        dictionary = names.reverse([to_bytes(n) for n in self.known], self.groups, True)
        self.full, self.wait = lambda text: (dictionary.replace(text), []), dictionary.longest + 1


def unmask_stream(pieces: DataFrame, known: list[str], groups: list[int] | None = None, timeout_ms: int | None = None) -> DataFrame:
    """Aliases back to names over a stream of pieces; columns as of ``redact_stream``, without events."""
    return _stream(pieces, _Unmasker(known, groups, timeout_ms), "append").drop("events")
