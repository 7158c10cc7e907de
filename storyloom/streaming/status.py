"""Status of ingestion jobs, kept by a listener of streaming queries."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from storyloom.sources.saved import STATUS


class JobStatus(StreamingQueryListener):
    """Running, success or failed for each named query, with the last times and message.

    A new run keeps the finish time of the one before until it ends itself.
    """

    def __init__(self) -> None:
        self.jobs: dict[str, dict] = {}
        self.names: dict[str, str] = {}

    def _note(self, job: str, **facts) -> None:  # noqa: ANN003
        now = datetime.now(timezone.utc).isoformat()
        self.jobs[job] = {"started_at": None, "finished_at": None, "message": None} | self.jobs.get(job, {}) | facts | {"updated_at": now}

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        job = self.names[str(event.runId)] = event.name or str(event.id)
        self._note(job, status="running", ok=True, started_at=event.timestamp)

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        job = event.progress.name or str(event.progress.id)
        self._note(job, message=f"batch {event.progress.batchId}: {event.progress.numInputRows} rows")

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        job = self.names.get(str(event.runId), str(event.id))
        failed = event.exception is not None
        facts = {"status": "failed" if failed else "success", "ok": not failed, "finished_at": datetime.now(timezone.utc).isoformat()}
        self._note(job, **facts, **({"message": event.exception} if failed else {}))

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(job, job, x.get("status"), x.get("ok"), None, x["message"], x["started_at"], x["finished_at"], x["updated_at"], None) for job, x in self.jobs.items()]
        return spark.createDataFrame(rows, STATUS)
