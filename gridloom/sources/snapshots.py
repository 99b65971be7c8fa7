"""Snapshots for devices: one SQLite file with a game, its symbols and its layouts in order.

Such a file is bounded by what a device can hold (half a million layouts make some 40 MB), so one task makes it from the
sorted rows, in memory, and puts it into the shared folder whole. The version tables of ``sinks`` hold data of any size.
"""

from __future__ import annotations

import hashlib
import json
import re
import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.boards import Game
from gridloom.runtime import exists, put_in_place, qualified

# The tables of the format.
TABLES = """
CREATE TABLE metadata (key TEXT PRIMARY KEY, value TEXT NOT NULL);
CREATE TABLE games (id INTEGER PRIMARY KEY, code TEXT, name TEXT, rows INTEGER, columns INTEGER, spin_cost INTEGER, signature_cell_width INTEGER, layout_count INTEGER, dataset_version INTEGER, rules_version INTEGER);
CREATE TABLE symbols (game_id INTEGER, mobile_code INTEGER, code TEXT, name TEXT, name_pl TEXT, name_en TEXT, is_wildcard INTEGER, display_order INTEGER, image_asset_key TEXT, PRIMARY KEY (game_id, mobile_code));
CREATE TABLE layouts (game_id INTEGER, sequence_number INTEGER, signature TEXT, payout INTEGER, PRIMARY KEY (game_id, sequence_number)) WITHOUT ROWID;
CREATE INDEX layouts_by_signature ON layouts (game_id, signature);
"""
FACTS = "layouts bigint, declared bigint, first bigint, last bigint, contiguous boolean, negative bigint, undecodable bigint, unknown_symbols bigint, checksum_equal boolean, valid boolean"


def _line(number: int, signature: str, payout: int) -> bytes:
    return f"{number}|{signature}|{payout}\n".encode()


def write_snapshot(layouts: DataFrame, path: str, game: Game = Game(), code: str = "game", dataset_version: int = 1, rules_version: int = 1) -> None:
    """Write ``layouts(sequence_number, signature, payout)`` as a snapshot to ``path``, which must not exist.

    Numbers must be 1, 2, ... without a gap or a repetition, payouts not negative and no value null; anything else is an
    error, and nothing is written. The metadata have a SHA-256 over game, symbols and all layouts in their order.
    """
    spark, target = layouts.sparkSession, qualified(layouts.sparkSession, path)
    if exists(spark, path):
        raise ValueError(f"there is a snapshot at {path} already")
    symbols = [(1, s, f"S{s}", f"Symbol {s}", None, None, int(s in game.wildcards), i, None) for i, s in enumerate((*game.symbols, *game.wildcards), start=1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        db, n = sqlite3.connect(":memory:"), 0
        db.executescript(TABLES)
        digest = hashlib.sha256(json.dumps([code, game.rows, game.columns, game.spin_cost, game.width, symbols]).encode())
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            for number, signature, payout in rows:
                n += 1
                if number != n or signature is None or payout is None or payout < 0:
                    raise ValueError(f"layout {number} is not the next one, or has no valid signature or payout")
                digest.update(_line(number, signature, payout))
            db.executemany("INSERT INTO layouts VALUES (1, ?, ?, ?)", rows)
        db.execute("INSERT INTO games VALUES (1, ?, ?, ?, ?, ?, ?, ?, ?, ?)", (code, code, game.rows, game.columns, game.spin_cost, game.width, n, dataset_version, rules_version))
        db.executemany("INSERT INTO symbols VALUES (?, ?, ?, ?, ?, ?, ?, ?, ?)", symbols)
        db.executemany("INSERT INTO metadata VALUES (?, ?)", [("schema_version", "1"), ("layout_count", str(n)), ("checksum_sha256", digest.hexdigest())])
        db.commit()
        where, name = fs.FileSystem.from_uri(target)
        where.create_dir(name.rpartition("/")[0], recursive=True)
        with where.open_output_stream(name + ".part") as f:
            f.write(db.serialize())
        put_in_place(where, name + ".part", name)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    ordered = layouts.select("sequence_number", "signature", "payout").repartition(1).sortWithinPartitions("sequence_number")
    ordered.mapInArrow(run, "n bigint").write.format("noop").mode("overwrite").save()


def _opened(target: str) -> sqlite3.Connection:
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(target)
    db = sqlite3.connect(":memory:")
    with where.open_input_file(name) as f:
        db.deserialize(f.read())
    return db


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """``(sequence_number, signature, payout)`` of a snapshot. A file without its metadata is an error."""
    target = qualified(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            db = _opened(target)
            if db.execute("SELECT value FROM metadata WHERE key = 'schema_version'").fetchone() != ("1",):
                raise ValueError(f"{target} is no snapshot of this format")
            found = db.execute("SELECT sequence_number, signature, payout FROM layouts ORDER BY sequence_number")
            while rows := found.fetchmany(10_000):
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64()))], names=["sequence_number", "signature", "payout"])

    return spark.range(1).coalesce(1).mapInArrow(run, "sequence_number bigint, signature string, payout bigint")


def validate_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """One row of facts about a snapshot: how many layouts there are and should be, the first and last number, whether they
    follow each other, negative payouts, signatures that are no whole cells, cells that are no symbol, and whether the
    checksum over game, symbols and ordered layouts is the stored one. ``valid`` is all of it."""
    target = qualified(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            db = _opened(target)
            code, rows, columns, cost, width, declared = db.execute("SELECT code, rows, columns, spin_cost, signature_cell_width, layout_count FROM games").fetchone()
            symbols = db.execute("SELECT * FROM symbols ORDER BY display_order").fetchall()
            stored = dict(db.execute("SELECT key, value FROM metadata").fetchall())
            digest = hashlib.sha256(json.dumps([code, rows, columns, cost, width, symbols]).encode())
            whole, known = re.compile(rf"[0-9]{{{width * rows * columns}}}"), {s[1] for s in symbols}
            n = negative = undecodable = unknown = 0
            first, last, contiguous = None, None, True
            for number, signature, payout in db.execute("SELECT sequence_number, signature, payout FROM layouts ORDER BY sequence_number"):
                n += 1
                first, last, contiguous = number if first is None else first, number, contiguous and number == n
                negative += payout < 0
                if not whole.fullmatch(signature):
                    undecodable += 1
                else:
                    unknown += any(int(signature[i : i + width]) not in known for i in range(0, len(signature), width))
                digest.update(_line(number, signature, payout))
            same = stored.get("checksum_sha256") == digest.hexdigest() and stored.get("layout_count") == str(n)
            valid = n == declared and contiguous and not negative and not undecodable and not unknown and same
            facts = (n, declared, first, last, contiguous, negative, undecodable, unknown, same, valid)
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.bool_() if isinstance(x, bool) else pa.int64()) for x in facts], names=[x.split()[0] for x in FACTS.split(", ")])

    return spark.range(1).coalesce(1).mapInArrow(run, FACTS).select(*[F.col(x.split()[0]) for x in FACTS.split(", ")])
