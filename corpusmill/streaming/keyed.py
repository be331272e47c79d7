"""Streams with a state of their own for each key: conversation contexts, gated profile memory, states of documents.

Each is a ``StatefulProcessor`` for ``transformWithState``: rows of a key come in micro-batches, in any
cut, are taken in order within a batch, and the result is that of a fold over all of them. State lies in
RocksDB (``spark.sql.streaming.stateStore.providerClass``) and goes on from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .state import merged_memory

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def in_order(rows: Iterator[Row], *by: str) -> list[Row]:
    """The rows of a key in a micro-batch, in order."""
    return sorted(rows, key=lambda r: tuple((r[c] is not None, r[c]) for c in by))


class ContextCache(StatefulProcessor):
    """The last messages of each of a caller's newest sessions; the session that came first goes when there are too many."""

    def __init__(self, most_sessions: int, most_messages: int, idle_ms: int | None):
        self.most_sessions, self.most_messages, self.idle_ms = most_sessions, most_messages, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # a session that is idle for long goes by itself
        self.sessions = handle.getMapState("sessions", "session string", "born long, messages array<string>", self.idle_ms)
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        born = self.count.get()[0] if self.count.exists() else 0
        held = {k[0]: (v[0], list(v[1])) for k, v in self.sessions.iterator()} if self.sessions.exists() else {}
        for r in in_order(rows, "seq"):
            evicted = None
            if r.session not in held:
                if len(held) >= self.most_sessions:
                    evicted = min(held, key=lambda s: held[s][0])
                    del held[evicted]
                    self.sessions.removeKey((evicted,))
                held[r.session] = born, []
                born += 1
            messages = (held[r.session][1] + [m for m in (r.question, r.answer) if m is not None])[-self.most_messages :]
            held[r.session] = held[r.session][0], messages
            self.sessions.updateValue((r.session,), held[r.session])
            yield Row(config=key[0], seq=r.seq, session=r.session, messages=messages, evicted=evicted)
        self.count.update((born,))

    def close(self) -> None:
        pass


class ProfileMemory(StatefulProcessor):
    """What is remembered of a user, renewed when enough rounds or time have passed since the last time."""

    def __init__(self, rounds: int, minutes: float):
        self.rounds, self.minutes = rounds, minutes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.memory = handle.getValueState("memory", "contents array<string>, confidences array<double>, round long, at double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        contents, confidences, last, at = self.memory.get() if self.memory.exists() else ([], [], None, None)
        items = list(zip(contents, confidences, strict=True))
        for r in in_order(rows, "round"):
            now = r.ts.timestamp()
            if last is not None and r.round - last < self.rounds and now - at < 60 * self.minutes:
                continue
            items, last, at = merged_memory(items, [(i["content"], i["confidence"]) for i in r.found or []]), r.round, now
            yield Row(user_id=key[0], round=r.round, items=[Row(content=c, confidence=f) for c, f in items])
        self.memory.update(([c for c, _ in items], [f for _, f in items], last, at))

    def close(self) -> None:
        pass


class Transitions(StatefulProcessor):
    """The state of a document, changed only as the table of legal changes allows."""

    def __init__(self, legal: set[tuple[str, str]], first: str):
        self.legal, self.first = legal, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = self.state.get()[0] if self.state.exists() else self.first
        for r in in_order(rows, "seq"):
            allowed = (now, r.wanted) in self.legal
            yield Row(doc_id=key[0], seq=r.seq, state=now, wanted=r.wanted, legal=allowed)
            now = r.wanted if allowed else now
        self.state.update((now,))

    def close(self) -> None:
        pass


def contexts(turns: DataFrame, most_sessions: int = 100, most_messages: int = 40, idle_ms: int | None = None) -> DataFrame:
    """config, seq, session, messages, evicted of a stream of turns (config, session, seq, question, answer).

    After each turn the messages that its session's context has, the newest ``most_messages``. A caller (config)
    has ``most_sessions`` sessions; for one more, the one that was begun first is evicted, and begins anew if it
    comes back. With ``idle_ms`` sessions without turns for that long go as well.
    """
    rows = turns.select("config", "session", "seq", "question", "answer")
    out = "config string, seq long, session string, messages array<string>, evicted string"
    return rows.groupBy("config").transformWithState(ContextCache(most_sessions, most_messages, idle_ms), out, "append", "ProcessingTime" if idle_ms else "None")


def gated_memory(rounds: DataFrame, every: int = 5, minutes: float = 30.0) -> DataFrame:
    """user_id, round, items after each time the memory is renewed, of a stream (user_id, round, ts, found: items of the round).

    It is renewed in a user's first round, and in one that is ``every`` rounds or ``minutes`` after the last
    time; what is found in between is not looked at. Items are merged as ``merged_memory`` says.
    """
    rows = rounds.select("user_id", "round", "ts", "found")
    out = "user_id string, round long, items array<struct<content: string, confidence: double>>"
    return rows.groupBy("user_id").transformWithState(ProfileMemory(every, minutes), out, "append", "None")


def document_states(asked: DataFrame, legal: list[tuple[str, str]], first: str) -> DataFrame:
    """doc_id, seq, state, wanted, legal of a stream of asked changes (doc_id, seq, wanted): an illegal one changes nothing."""
    rows = asked.select("doc_id", "seq", "wanted")
    return rows.groupBy("doc_id").transformWithState(Transitions(set(legal), first), "doc_id string, seq long, state string, wanted string, legal boolean", "append", "None")
