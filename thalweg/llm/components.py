"""Connected components of links, distributed."""

from __future__ import annotations

from thalweg.operators.components import components  # noqa: F401
