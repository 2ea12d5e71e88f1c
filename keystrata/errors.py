"""Outcomes of operations, by name, and the exception that carries one."""

from __future__ import annotations

# The outcomes this engine can report, and what they say.
STATUS = {
    "SUCCESS": "the operation succeeded",
    "INVALID_PARAMETER": "a parameter is not valid",
    "CONTAINER_UNKNOWN": "no container has that name or id",
    "CONTAINER_EXISTS": "a container of that name exists",
    "FAILURE_INVALID_CONTAINER_TYPE": "the container's kind does not allow the operation",
    "CANNOT_REDUCE_CONTAINER_SIZE": "a container cannot shrink below its configured size",
    "CANNOT_DELETE_OPEN_CONTAINER": "the container is open",
    "OBJECT_UNKNOWN": "no live object has that key",
    "OBJECT_EXISTS": "a live object has that key",
    "OBJECT_TOO_BIG": "the data is larger than an object may be",
    "KEY_TOO_LONG": "the key is longer than a key may be",
    "BAD_KEY": "the key does not follow the log key grammar",
    "INVALID_RANGE": "the flags and keys of the range do not fit together",
    "QUERY_DONE": "the range has no more rows",
    "QUERY_PAUSED": "the range stopped before this key",
    "STATE_CHANGED": "the container or the catalog was changed meanwhile",
    "EXPIRED": "the object has expired",
    "SNAPSHOT_NOT_FOUND": "no snapshot has that sequence number",
    "TOO_MANY_SNAPSHOTS": "the container has no room for another snapshot",
    "FAILURE_NO_TRANS": "no transaction is active",
    "TRANS_LEVEL_EXCEEDED": "a transaction is already active",
    "FAILURE_OPERATION_DISALLOWED": "the operation is not allowed here",
}


class StoreError(Exception):
    """An operation that ended with a status other than SUCCESS."""

    def __init__(self, status: str, detail: str = ""):
        self.status = status
        super().__init__(f"{status}: {detail or STATUS[status]}")


def describe(status: str) -> str:
    return STATUS.get(status, "unknown status")
