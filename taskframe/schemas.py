"""Tables of the engine. Unsigned 64-bit masks are kept as BIGINT bit patterns and only tested bit by bit."""

TIME = "STRUCT<secs_since_epoch: BIGINT, nanos_since_epoch: INT>"

#: One row per task; `id` grows with submission, so an edge's src is always below its dst.
TASKS = (
    "id BIGINT, cmdline ARRAY<STRING>, key STRING, display STRING, affinity BIGINT, runcount BIGINT, priority BIGINT, "
    "storage_root BIGINT, fd_input STRUCT<fd: INT, buf: BINARY>"
)
EDGES = "src BIGINT, dst BIGINT"

#: A log line holds exactly one of the five records. Names and nesting of the file format, version 4.
LOG_VERSION = 4
TAGS = ["Header", "Ready", "Started", "Finished", "Backref"]
LOG = f"""
Header STRUCT<version: BIGINT, time: {TIME}, user: STRING, hostname: STRING, workflow_key: STRING, cmdline: ARRAY<STRING>,
  workdir: STRING, pid: BIGINT, storage_roots: ARRAY<STRING>>,
Ready STRUCT<time: {TIME}, key: STRING, runcount: BIGINT, command: STRING, r: BIGINT>,
Started STRUCT<time: {TIME}, key: STRING, host: STRING, pid: BIGINT, slurm_jobid: STRING>,
Finished STRUCT<time: {TIME}, key: STRING, status: INT, values: ARRAY<MAP<STRING, STRING>>>,
Backref STRUCT<key: STRING>
"""
