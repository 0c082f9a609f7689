"""Codes of sessions that go on over many calls: keyed state in a stream.

A session's state holds the number of each value (a map keyed by type and value, of which a batch reads only what its
documents name), the last number of each type, and the numbers that its texts reserve. Documents that arrive later
take the codes of values that are known, and new values go on counting. The state is in Spark's checkpoint, so a stopped
stream goes on where it was.

In each batch a session's documents are taken in their order, after all of the batch's own tokens are reserved; with
`sessions.session_codes`, which knows all documents from the start, all tokens are. The codes are the same unless a
later batch reserves a number that an earlier one has given. A session's part of a micro-batch is handled by one task:
bound it by the source's rate. Whole tables go through `session_codes`, which splits sessions.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.replace import LABELS, reserved_tokens
from ..operators.spans import merge_confirmed

#: The state store that keyed maps need; a session sets it before the stream starts.
STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Mapper(StatefulProcessor):
    """Rows (key, o, doc, body, held, marks) of one session -> session, doc, anonymized, codes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.numbers = handle.getMapState("numbers", "type string, original string", "number long")
        self.last = handle.getMapState("last", "type string", "number long")
        self.held = handle.getMapState("held", "code string", "seen boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        docs = pd.concat(list(rows)).sort_values("o", kind="stable")
        for code in {c for held in docs["held"] for c in held}:
            if not self.held.containsKey((code,)):
                self.held.updateValue((code,), (True,))
        known: dict[tuple[str, str], int] = {}
        last: dict[str, int] = {}
        out = []
        for doc, body, marks in zip(docs["doc"], docs["body"], docs["marks"], strict=True):
            at, parts, codes = 0, [], {}
            for m in marks:
                value = m["type"], body[m["start"] : m["end"]]
                codes[value] = code = self._code(value, known, last)
                parts += body[at : m["start"]], code
                at = m["end"]
            used = [{"original": v, "pseudonym": c, "type": k} for (k, v), c in codes.items()]
            out.append((key[0], doc, "".join([*parts, body[at:]]), used))
        for kind, number in last.items():
            self.last.updateValue((kind,), (number,))
        yield pd.DataFrame(out, columns=["session", "doc", "anonymized", "codes"])

    def _code(self, value: tuple[str, str], known: dict[tuple[str, str], int], last: dict[str, int]) -> str:
        kind, _ = value
        shown = lambda n: f"[[{LABELS[kind]}_{n:03d}]]"
        if value not in known:
            if self.numbers.containsKey(value):
                known[value] = self.numbers.getValue(value)[0]
            else:
                if kind not in last:
                    last[kind] = self.last.getValue((kind,))[0] if self.last.containsKey((kind,)) else 0
                last[kind] += 1
                while self.held.containsKey((shown(last[kind]).lower(),)):
                    last[kind] += 1
                known[value] = last[kind]
                self.numbers.updateValue(value, (last[kind],))
        return shown(known[value])

    def close(self) -> None:
        pass


def map_sessions(docs: DataFrame, session: str, order: str, key: str = "doc_id", text: str = "text", spans: str = "spans") -> DataFrame:
    """A stream of docs (session, order, key, text, spans) -> session, key, anonymized, codes (original, pseudonym, type): what each document needs to be restored.

    Null texts are empty; a null session is a session. One row for each document.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(session).cast("string").alias("session"), F.col(order).alias("o"), F.col(key).alias("doc"), body.alias("body"), reserved_tokens(body).alias("held"), merge_confirmed(body, F.col(spans)).alias("marks"))
    kind = rows.schema["doc"].dataType.simpleString()
    out = rows.groupBy("session").transformWithStateInPandas(Mapper(), f"session string, doc {kind}, anonymized string, codes array<struct<original:string,pseudonym:string,type:string>>", "Append", "None")
    return out.withColumnRenamed("doc", key).withColumnRenamed("session", session)
