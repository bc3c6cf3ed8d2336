"""Query bindings: each registered query = (spark, sf_dir) -> DataFrame over
the driver tables, plus the DuckDB SQL that computes the same result."""

from __future__ import annotations

from . import chat as _chat
from . import evaluation as _evaluation
from . import gen as _gen
from . import memory as _memory
from . import policy as _policy
from . import rag as _rag
from . import src as _src
from . import streams as _streams
from . import retail as _retail

REGISTRY: dict[str, tuple] = {}
for _mod in (_src, _retail, _chat, _memory, _evaluation, _rag, _streams, _gen, _policy):
    REGISTRY.update(_mod.QUERIES)
