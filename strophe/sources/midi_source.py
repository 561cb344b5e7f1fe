"""MIDI files as a Spark data source: ``spark.read.format("midi")``.

    spark.dataSource.register(MidiSource)
    spark.read.format("midi").load(folder)
    events.write.format("midi").mode("append").save(folder)

Reading gives the rows of ``midi.parsed``; a file is never split, and files are
dealt to partitions by size.  Writing takes the event
rows of ``midi.files`` and makes one file a session.  Tasks write under names of
their own; the files get their names when the whole job commits, so a failed
task or job leaves none.

Rows of one session have to lie in one partition (``repartition("session_id")``
before writing); if they don't, the second partition's commit is an error.
Folders are local or mounted paths that driver and executors share.
"""

from __future__ import annotations

import os
import uuid
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import quote

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from strophe.sources import midi

#: Event columns, and what stands for a null.
EVENTS = {"tick": 0, "kind": "", "pitch": 0, "velocity": 96, "tempo_us": 500_000, "text": ""}


def _plain(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


@dataclass
class Files(InputPartition):
    paths: Sequence[str]


@dataclass
class Written(WriterCommitMessage):
    """Temporary and final names of a task's files."""

    moves: list[tuple[str, str]]


class MidiReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.bytes = _plain(options["path"]), int(options.get("partitionbytes", 16 << 20))

    def partitions(self) -> Sequence[InputPartition]:
        """Files in order, as many to a partition as fit into its bytes."""
        out, size = [[]], 0
        for p in sorted(x for x in Path(self.folder).rglob("*.mid") if not x.name.startswith((".", "_"))):
            n = p.stat().st_size
            if out[-1] and size + n > self.bytes:
                out.append([])
                size = 0
            out[-1].append(str(p))
            size += n
        return [Files(x) for x in out]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            try:
                ppq, found = midi.messages(Path(path).read_bytes())
            except (ValueError, IndexError) as e:
                ppq, found = 0, [(0, "error", None, None, None, str(e))]
            for n, message in enumerate(found):
                yield (path, ppq, n, *message)


class MidiWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.overwrite = _plain(options["path"]), overwrite
        self.ppq = int(options.get("ppq", midi.PPQ))
        os.makedirs(self.folder, exist_ok=True)

    def write(self, rows) -> WriterCommitMessage:
        held = defaultdict(list)
        for r in rows:
            held[r["session_id"]].append(tuple(other if r[c] is None else r[c] for c, other in EVENTS.items()))
        moves = []
        for session, events in held.items():
            temporary = f"{self.folder}/.{uuid.uuid4()}.part"
            Path(temporary).write_bytes(midi.encode(sorted(events), self.ppq))
            moves.append((temporary, f"{self.folder}/{quote(str(session), safe='')}.mid"))
        return Written(moves)

    def commit(self, messages) -> None:
        moves = [m for x in messages if x is not None for m in x.moves]
        names = [final for _, final in moves]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("a session's rows lie in several partitions; repartition by session_id before writing")
        if self.overwrite:
            for p in Path(self.folder).glob("*.mid"):
                if str(p) not in names:
                    p.unlink()
        for temporary, final in moves:
            os.replace(temporary, final)

    def abort(self, messages) -> None:
        for x in messages:
            for temporary, _ in x.moves if x is not None else ():
                Path(temporary).unlink(missing_ok=True)


class MidiSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "midi"

    def schema(self) -> str:
        return midi.MESSAGES

    def reader(self, schema) -> DataSourceReader:
        return MidiReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return MidiWriter(self.options, overwrite)
