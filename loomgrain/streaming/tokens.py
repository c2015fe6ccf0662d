"""Answers that arrive in pieces: keyed state holds the unfinished line, so that lines cut by the network are whole again."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LINE = "id string, seq int, line string"


class WholeLines(StatefulProcessor):
    """Lines of each answer. State: the bytes of its open line, the numbers of the next piece and line, whether it has ended, and pieces that came early."""

    def __init__(self, events: bool) -> None:
        self.events = events

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "rest binary, piece long, seq int, ended boolean")
        self.early = handle.getMapState("early", "n long", "piece binary, last boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        rest, piece, seq, ended = self.open.get() if self.open.exists() else (b"", 0, 0, False)
        came = {r.n: (bytes(r.piece or b""), bool(r.last)) for r in rows if r.n is not None and r.n >= piece}
        rest, out = bytearray(rest), []
        while not ended:
            if piece in came:
                data, last = came.pop(piece)
            elif self.early.containsKey((piece,)):
                data, last = self.early.getValue((piece,))
                self.early.removeKey((piece,))
            else:
                break
            piece += 1
            found = 0 if b"\n" not in data else len(rest)  # what was searched before holds no line end
            rest += data
            at = 0
            lines = []
            while found is not None and (end := rest.find(b"\n", max(at, found))) >= 0:
                lines.append(bytes(rest[at:end]).removesuffix(b"\r"))
                at = end + 1
            del rest[:at]
            if last:
                lines.append(bytes(rest))
                rest, ended = bytearray(), True
            for x in lines:
                if self.events:
                    if not x.startswith(b"data: "):
                        continue
                    x = x[6:]  # noqa: PLW2901
                    if x == b"[DONE]":
                        rest, ended = bytearray(), True
                        break
                out.append(Row(id=key[0], seq=seq, line=x.decode("utf-8", "replace")))
                seq += 1
        if not ended:
            for n, value in came.items():
                self.early.updateValue((n,), value)
        elif self.early.exists():
            self.early.clear()
        self.open.update((bytes(rest), piece, seq, ended))
        return iter(out)

    def close(self) -> None:
        pass


def _lines(pieces: DataFrame, events: bool) -> DataFrame:
    own = pieces.where("id IS NOT NULL").select(F.col("id").cast("string").alias("id"), F.col("n").cast("long").alias("n"), F.col("piece").cast("binary").alias("piece"), "last")
    return own.groupBy("id").transformWithState(WholeLines(events), LINE, "append", "none")


def ndjson_token_stream(pieces: DataFrame) -> DataFrame:
    """(id, seq, token) as of ``services.ndjson_tokens``, from a stream of pieces (id, n, piece, last).

    ``n`` numbers the pieces of an answer from 0; they may come in any order and more
    than once, and may be cut anywhere, inside a character too. ``last`` marks the
    end. Tokens come with the piece that ends their line. Needs the RocksDB state store.
    """
    found = _lines(pieces, False).withColumn("token", F.get_json_object("line", "$.message.content"))
    return found.where("token IS NOT NULL AND token <> ''").drop("line")


def sse_token_stream(pieces: DataFrame) -> DataFrame:
    """(id, seq, token) as of ``services.sse_tokens``, from a stream of pieces as of ``ndjson_token_stream``; the end mark ends an answer, too."""
    found = _lines(pieces, True).withColumn("token", F.get_json_object("line", "$.choices[0].delta.content"))
    return found.where("token IS NOT NULL AND token <> ''").drop("line")
