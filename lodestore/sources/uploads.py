"""Uploads to a folder: capped, hashed, written aside and renamed once complete (SRC22)."""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterable

MOST = 512 << 20


class TooLarge(ValueError):
    pass


def store(folder: str, key: str, parts: Iterable[bytes], most: int = MOST) -> tuple[int, str]:
    """Size and SHA-256 of what was stored under ``key``. Nothing remains of an upload that exceeds ``most`` bytes."""
    os.makedirs(folder, exist_ok=True)
    digest, size = hashlib.sha256(), 0
    handle, aside = tempfile.mkstemp(dir=folder, prefix=".upload-")
    try:
        with os.fdopen(handle, "wb") as f:
            for part in parts:
                size += len(part)
                if size > most:
                    raise TooLarge(f"more than {most} bytes")
                digest.update(part)
                f.write(part)
            f.flush()
            os.fsync(f.fileno())
        os.replace(aside, os.path.join(folder, key))
    except BaseException:
        os.unlink(aside)
        raise
    return size, digest.hexdigest()
