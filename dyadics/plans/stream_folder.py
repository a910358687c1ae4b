"""A fresh folder that all executors share, for what a replayed stream writes and reads."""

from __future__ import annotations

import uuid

from ..session import shared_folder as _base


def shared_folder(spark) -> str:
    return f"{_base(spark)}/stream-{uuid.uuid4().hex}"
