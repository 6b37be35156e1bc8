"""Scans, results and findings as Parquet snapshots with one manifest, and the lease that lets one scan write.

Each scan writes new folders; a commit is the replacement of the manifest, which names the folders that hold, and is made
under a lock. The store's folder is one that the driver can rename files in and that all executors share (a mounted file system).
Folders of scans that were pruned or failed are deleted; replaced findings go a day later, as someone may be reading them.
"""

from __future__ import annotations

import json
import os
import shutil
import threading
import time
import uuid
from collections.abc import Callable, Iterable
from contextlib import contextmanager, suppress
from datetime import UTC, datetime, timedelta
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from trustlake.functions.text import sanitized_error
from trustlake.operators import findings as W
from trustlake.operators import history as H
from trustlake.plans.audit import Settings, audit

LEASE_SECONDS, RENEW_SECONDS = 300, 60
#: A lock is held for the moments between reading and writing a small file; an older one was left by a process that died.
LOCK_SECONDS = 30
SWEEP_SECONDS = 24 * 3600
KEEP_SCANS = 20
SCAN = "scan_id long, started_at timestamp, finished_at timestamp, document_count long, status string, error string"


class LeaseLost(RuntimeError):
    """Another worker took the lease over, or it ran out."""


class Store:
    """An audit store in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, Path(folder.removeprefix("file://"))
        self.folder.mkdir(parents=True, exist_ok=True)

    # the manifest

    def _read(self) -> dict:
        path = self.folder / "manifest.json"
        return json.loads(path.read_text()) if path.exists() else {"next_scan": 1, "scans": [], "results": {}, "looked": {}, "findings": None}

    def _commit(self, state: dict) -> None:
        path = self.folder / f"manifest-{uuid.uuid4().hex}.json"
        path.write_text(json.dumps(state))
        os.replace(path, self.folder / "manifest.json")

    def _change(self, change: Callable[[dict], dict]) -> dict:
        """Commit change of what the manifest says now; no other process commits between."""
        with self._locked():
            state = change(self._read())
            self._commit(state)
            return state

    def _put(self, df: DataFrame, name: str) -> str:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"file://{path}")
        return path

    def _table(self, *paths: str) -> DataFrame:
        return self.spark.read.parquet(*[f"file://{p}" for p in paths])

    def _delete(self, paths: Iterable[str | None]) -> None:
        """Remove folders that the manifest does not name."""
        state = self._read()
        named = {*state["results"].values(), *state["looked"].values(), state["findings"]}
        for path in set(paths) - named - {None}:
            shutil.rmtree(path, ignore_errors=True)

    def sweep(self, older: float = SWEEP_SECONDS) -> int:
        """Delete folders that the manifest does not name and nobody has written for `older` seconds: replaced findings, which someone
        may just be reading, and what dead workers left."""
        state = self._read()
        named = {*state["results"].values(), *state["looked"].values(), state["findings"]}
        left = [p for p in self.folder.iterdir() if p.is_dir() and str(p) not in named and self._age(p) > older]
        for path in left:
            shutil.rmtree(path, ignore_errors=True)
        return len(left)

    # the lease

    def _lease(self) -> dict:
        path = self.folder / "lease.json"
        return json.loads(path.read_text()) if path.exists() else {}

    @contextmanager
    def _locked(self, wait: float = LOCK_SECONDS):
        """One process at a time. A lock left by a process that died is taken over; FileExistsError if it is still held after `wait` seconds."""
        path, began = self.folder / "store.lock", time.monotonic()
        while True:
            try:
                os.close(os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
                break
            except FileExistsError:
                if self._age(path) > LOCK_SECONDS:
                    left = path.with_name(f"left-{uuid.uuid4().hex}")
                    with suppress(FileNotFoundError):  # one of those that see it renames it
                        os.replace(path, left)
                        left.unlink()
                elif time.monotonic() - began > wait:
                    raise
                else:
                    time.sleep(0.05)
        try:
            yield
        finally:
            path.unlink(missing_ok=True)

    @staticmethod
    def _age(path: Path) -> float:
        with suppress(FileNotFoundError):
            return time.time() - path.stat().st_mtime
        return 0.0

    def try_start(self, now: datetime) -> str | None:
        """A token, or None while another worker's lease runs. Scans of a worker whose lease ran out are failed."""
        with self._locked():
            held = self._lease()
            if held and datetime.fromisoformat(held["until"]) > now:
                return None
            state = self._read()
            for scan in state["scans"]:
                if scan["status"] == "running":
                    scan |= {"status": "failed", "finished_at": now.isoformat(), "error": "Abandoned by its worker"}
            self._commit(state)
            token = uuid.uuid4().hex
            self._write_lease(token, now)
            return token

    def _write_lease(self, token: str, now: datetime) -> None:
        path = self.folder / f"lease-{token}.tmp"
        path.write_text(json.dumps({"token": token, "until": (now + timedelta(seconds=LEASE_SECONDS)).isoformat()}))
        os.replace(path, self.folder / "lease.json")

    def owns(self, token: str, now: datetime) -> bool:
        held = self._lease()
        return held.get("token") == token and datetime.fromisoformat(held["until"]) > now

    def renew(self, token: str, now: datetime) -> bool:
        with self._locked():
            if not self.owns(token, now):
                return False
            self._write_lease(token, now)
            return True

    def end(self, token: str) -> None:
        with self._locked():
            if self._lease().get("token") == token:
                (self.folder / "lease.json").unlink(missing_ok=True)

    def scanning(self, now: datetime) -> bool:
        held = self._lease()
        return bool(held) and datetime.fromisoformat(held["until"]) > now

    def check(self, token: str | None) -> None:
        if token is not None and not self.owns(token, datetime.now(UTC)):
            raise LeaseLost("the lease of this scan has ended")

    # tables

    def scans(self) -> DataFrame:
        when = lambda s: datetime.fromisoformat(s) if s else None
        rows = [(s["scan_id"], when(s["started_at"]), when(s["finished_at"]), s["document_count"], s["status"], s["error"]) for s in self._read()["scans"]]
        return self.spark.createDataFrame(rows, SCAN)

    def results(self, scan_id: int | None = None) -> DataFrame | None:
        """The results of a scan, or of all completed scans."""
        paths = [p for k, p in self._read()["results"].items() if scan_id in (None, int(k))]
        return self._table(*paths) if paths else None

    def findings(self) -> DataFrame:
        path = self._read()["findings"]
        return self._table(path) if path else self.spark.createDataFrame([], W.FINDING)

    def finding(self, finding_key: str) -> DataFrame | None:
        """One finding with its audit (no row for an unknown key); None in a store without results."""
        results = self.results()
        return W.one(self.findings(), results, finding_key) if results is not None else None

    def _replace_findings(self, made: Callable[[DataFrame], DataFrame], state: Callable[[dict], dict] = lambda s: s) -> str:
        """Commit the findings that `made` makes of those that hold, and a change of the manifest with them. If others were committed
        in the meantime it is made again of those, so no change is lost. Returns the folder."""
        while True:
            old = self._read()["findings"]
            path = self._put(made(self._table(old) if old else self.spark.createDataFrame([], W.FINDING)), "findings")
            with self._locked():
                now = self._read()
                if now["findings"] == old:
                    self._commit(state(now) | {"findings": path})
                    break
            self._delete([path])
        return path

    def update_finding(self, finding_key: str, now: datetime, token: str | None = None, **fields) -> bool:
        """Change one finding; whether there is one. token: of a worker that must still hold the lease."""
        self.check(token)
        if not self.findings().where(F.col("finding_key") == finding_key).limit(1).count():
            return False
        self._replace_findings(lambda rows: W.update(rows, finding_key, now, **fields))
        return True

    def clear(self, now: datetime) -> bool:
        """Remove everything, unless a scan runs."""
        if self.scanning(now):
            return False
        shutil.rmtree(self.folder)
        self.folder.mkdir()
        return True

    # scans

    def run(self, docs: DataFrame, settings: Settings, token: str | None = None, mode: str = "changed") -> tuple[int, DataFrame, dict[str, int]]:
        """Audit docs as a new scan: (scan id, results of the pages looked at, counts of changed findings).

        mode "changed": pages whose text is as it was keep their last results, and the others are looked at among themselves; "full": all are looked at."""
        now = settings.as_of
        self.check(token)
        begun: dict = {}

        def begin(state: dict) -> dict:
            scan = {"scan_id": state["next_scan"], "started_at": now.isoformat(), "finished_at": None, "document_count": 0, "status": "running", "error": None}
            begun.update(scan)
            return state | {"next_scan": scan["scan_id"] + 1, "scans": [*state["scans"], scan]}

        state = self._change(begin)
        scan_id, made = begun["scan_id"], []

        def kept(df: DataFrame, name: str) -> DataFrame:
            made.append(self._put(df, name))
            return self._table(made[-1])

        try:
            last = max((s["scan_id"] for s in state["scans"] if s["status"] == "completed"), default=None)
            before = self.results(last) if last is not None and mode == "changed" else None
            changed, same = H.split_unchanged(docs, before) if before is not None else (docs, None)
            results = whole = kept(audit(changed, settings).withColumn("scan_id", F.lit(scan_id).cast("long")), "looked")
            if same is not None:
                whole = results.unionByName(H.carried(before, scan_id, same.select(F.col("id").alias("document_id"))))
            rows = Observation()
            whole = kept(whole.observe(rows, F.count("*").alias("n")), "results")
            path, n = made[-1], rows.get["n"]
            changes: list[Observation] = []

            def merge(findings: DataFrame) -> DataFrame:
                self.check(token)
                merged, seen = W.counted(W.merge(findings, whole, scan_id, now, results.select("document_id"), whole.select("document_id")))
                changes.append(seen)
                return kept(merged, "merged").drop("change")

            def complete(state: dict) -> dict:
                self.check(token)
                done = {"status": "completed", "finished_at": datetime.now(UTC).isoformat(), "document_count": n}
                scans = [s | done if s["scan_id"] == scan_id else s for s in state["scans"]]
                return state | {"scans": scans, "results": state["results"] | {str(scan_id): path}, "looked": state["looked"] | {str(scan_id): made[0]}}

            self._replace_findings(merge, complete)
            counts = {k: changes[-1].get[k] for k in W.CHANGES}
        except LeaseLost:
            self._delete(made)
            raise
        except Exception as error:
            self._delete(made)
            self.fail(scan_id, str(error))
            raise
        self.prune()
        self._delete(made)
        self.sweep()
        return scan_id, results, counts

    def fail(self, scan_id: int, error: str) -> None:
        """Note a scan as failed; what it had stored is deleted."""
        text = self.spark.createDataFrame([(error,)], "e string").select(sanitized_error(F.col("e"))).first()[0]
        dropped: list[str | None] = []

        def failed(state: dict) -> dict:
            results = dict(state["results"])
            dropped.append(results.pop(str(scan_id), None))
            end = {"status": "failed", "finished_at": datetime.now(UTC).isoformat(), "error": text}
            return state | {"results": results, "scans": [s | end if s["scan_id"] == scan_id else s for s in state["scans"]]}

        self._change(failed)
        self._delete(dropped)

    def prune(self, keep: int = KEEP_SCANS) -> int:
        """Delete ended scans beyond the newest keep, with their results."""
        dropped: list[str] = []
        old: set[int] = set()

        def pruned(state: dict) -> dict:
            ended = sorted((s["scan_id"] for s in state["scans"] if s["status"] != "running"), reverse=True)
            old.update(ended[keep:])
            dropped.extend(p for table in ("results", "looked") for k, p in state[table].items() if int(k) in old)
            left = {table: {k: p for k, p in state[table].items() if int(k) not in old} for table in ("results", "looked")}
            return state | left | {"scans": [s for s in state["scans"] if s["scan_id"] not in old]}

        self._change(pruned)
        self._delete(dropped)
        return len(old)


class Heartbeat:
    """Renews a lease while a scan runs."""

    def __init__(self, store: Store, token: str, every: float = RENEW_SECONDS):
        self.store, self.token, self.every, self.done = store, token, every, threading.Event()

    def __enter__(self) -> Heartbeat:
        self.thread = threading.Thread(target=self._beat, daemon=True)
        self.thread.start()
        return self

    def _beat(self) -> None:
        while not self.done.wait(self.every):
            if not self.store.renew(self.token, datetime.now(UTC)):
                break

    def __exit__(self, *_) -> None:
        self.done.set()
        self.thread.join()
        self.store.end(self.token)
