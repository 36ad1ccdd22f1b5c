"""Small metadata operations on the file system a path belongs to (any Hadoop-supported store)."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """Full URI of a path, as file listings show it."""
    p, fs = _path(spark, path)
    return fs.makeQualified(p).toString()


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names directly under a folder; an absent folder has none."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p))


def present_days(spark: SparkSession, root: str) -> list[date]:
    """Days that have a folder, from one listing."""
    return [date.fromisoformat(n[4:]) for n in child_names(spark, root) if n.startswith("day=")]


def first_bytes(spark: SparkSession, path: str, count: int = 2) -> bytes:
    """The first few bytes of one file."""
    p, fs = _path(spark, path)
    stream = fs.open(p)
    try:
        got = [stream.read() for _ in range(count)]
    finally:
        stream.close()
    return bytes(b for b in got if b >= 0)


def visible_files(spark: SparkSession, path: str) -> dict[str, int]:
    """A file itself, or the data files directly in a folder, with their sizes, from one listing."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return {}
    found = [s for s in fs.listStatus(p) if s.getPath().toString() == fs.makeQualified(p).toString() or not s.getPath().getName().startswith(("_", "."))]
    if nested := sorted(s.getPath().getName() for s in found if s.isDirectory()):
        raise IsADirectoryError(f"{path} holds folders ({', '.join(nested)}), whose files would be left out")
    return dict(sorted((s.getPath().toString(), s.getLen()) for s in found))


def swap_in(spark: SparkSession, staged: str, final: str) -> None:
    """Put one finished file or folder in place of another one."""
    publish(spark, {"only": (staged, final)}, f"{staged.rstrip('/')}.journal")


class Held(RuntimeError):
    """Another run is publishing to the same place."""


#: A journal whose run has not been heard of for so long belongs to a run that was cut off; a run says so every minute.
LEASE_SECONDS = 900
_BEAT_SECONDS = 60


def _holder(spark: SparkSession, journal: str) -> tuple[str, float] | None:
    """Run that holds a journal, and when it was last heard of; none for a journal without an owner."""
    p, fs = _path(spark, f"{journal}/owner")
    try:
        stream = fs.open(p)
    except Exception:
        return None
    try:
        text = bytes(b for b in (stream.read() for _ in range(200)) if b >= 0).decode()
    finally:
        stream.close()
    run, _, heard = text.partition(" ")
    return (run, float(heard)) if heard else None


def _say(spark: SparkSession, journal: str, run: str, first: bool) -> None:
    """Note that a run holds the journal. The first note fails if another run's is there: file systems make new files one at a time."""
    p, fs = _path(spark, f"{journal}/owner")
    try:
        out = fs.create(p, not first)
    except Exception as why:
        raise Held(f"{journal} was taken by another run just now") from why
    out.write(bytearray(f"{run} {time.time()}".encode()))
    out.close()


def publish(spark: SparkSession, moves: dict[str, tuple[str | None, str]], journal: str) -> None:
    """Put finished folders in place of others, all of them or none.

    moves: name -> (staged folder, or None if nothing takes its place; final folder). What stands is first set aside in the
    journal folder, which has to be outside of anything that is dropped before the next run. If a run is cut off, recover()
    puts everything back. While one run publishes, others with the same journal are refused (Held) and change nothing."""
    run = uuid.uuid4().hex

    def place(name: str) -> str:
        return moves[name][1]

    recover(spark, place, journal)
    fs = _path(spark, journal)[1]
    heard = time.monotonic()

    def beat() -> None:
        nonlocal heard
        if time.monotonic() - heard > _BEAT_SECONDS:
            _say(spark, journal, run, first=False)
            heard = time.monotonic()

    def path(text):
        return _path(spark, text)[0]

    def rename(src, dst):
        fs.mkdirs(path(dst).getParent())
        if not fs.rename(path(src), path(dst)):
            raise OSError(f"could not move {src} to {dst}")

    fs.mkdirs(path(journal))
    _say(spark, journal, run, first=True)
    try:
        for name, (_, final) in moves.items():
            beat()
            if fs.exists(path(final)):
                rename(final, f"{journal}/old/{name}")
            else:
                fs.mkdirs(path(f"{journal}/absent/{name}"))
        fs.mkdirs(path(f"{journal}/all_aside"))
        for staged, final in moves.values():
            beat()
            if staged is not None:
                rename(staged, final)
        fs.mkdirs(path(f"{journal}/done"))
    except Exception:
        recover(spark, place, journal, run)
        raise
    drop(spark, journal)


def recover(spark: SparkSession, place: Callable[[str], str], journal: str, run: str | None = None) -> None:
    """Undo a publish() that was cut off; one that was through is only tidied up. Without a journal there is nothing to do.

    place gives the final folder of a name. A journal that another run than `run` holds is left alone: Held."""
    if not exists(spark, journal):
        return
    holder = _holder(spark, journal)
    if holder and holder[0] != run and time.time() - holder[1] < LEASE_SECONDS and not exists(spark, f"{journal}/done"):
        raise Held(f"run {holder[0]} is publishing with {journal}; if it was cut off, this works again {LEASE_SECONDS} seconds after it was last heard of")
    if not exists(spark, f"{journal}/done"):
        for name in child_names(spark, f"{journal}/old"):
            drop(spark, place(name))
            p, fs = _path(spark, f"{journal}/old/{name}")
            if not fs.rename(p, _path(spark, place(name))[0]):
                raise OSError(f"could not put {place(name)} back from {journal}")
        if exists(spark, f"{journal}/all_aside"):
            # there was nothing before; what was moved in belongs to the run that was cut off
            for name in child_names(spark, f"{journal}/absent"):
                drop(spark, place(name))
    drop(spark, journal)


def _in_days(final: str) -> Callable[[str], str]:
    """Final place of a name in the journal of a table of day folders: a day, or a file of it as day~file."""
    return lambda name: f"{final}/{name.replace('~', '/', 1)}"


def replace_days(spark: SparkSession, staged: str, final: str, days: list[date]) -> None:
    """Put staged day folders in place of exactly these days. A day without staged rows ends up
    without a folder, so that nothing stale is left of it. If a run is cut off, the next one for these days starts from
    what was there before."""
    have = set(present_days(spark, staged))
    moves = {f"day={d}": (f"{staged}/day={d}" if d in have else None, f"{final}/day={d}") for d in days}
    _publish_days(spark, moves, final)
    drop(spark, staged)


def add_to_days(spark: SparkSession, staged: str, final: str, days: list[date]) -> None:
    """Put the staged files of these days beside what stands there, under replace_days()' journal: all of them or none."""
    place = _in_days(final)
    names = [f"day={d}~{file}" for d in days for file in child_names(spark, f"{staged}/day={d}")]
    _publish_days(spark, {n: (f"{staged}/{n.replace('~', '/', 1)}", place(n)) for n in names}, final)
    drop(spark, staged)


def _publish_days(spark: SparkSession, moves: dict[str, tuple[str | None, str]], final: str) -> None:
    journal = f"{final.rstrip('/')}_journal"
    # a run that was cut off may have been about other days or files than this one
    recover(spark, _in_days(final), journal)
    if moves:
        publish(spark, moves, journal)


def drop(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    if fs.exists(p):
        fs.delete(p, True)
