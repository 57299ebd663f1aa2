"""Editorial and provenance analytics as DataFrame operators."""

from __future__ import annotations

import importlib
import pkgutil


def registered() -> tuple[dict, dict[str, str]]:
    """Queries over the driver's tables, and their SQL twins, of all modules of proofline.plans."""
    from proofline import plans
    from proofline.plans import registry

    for module in pkgutil.iter_modules(plans.__path__):
        importlib.import_module(f"proofline.plans.{module.name}")
    return dict(registry.QUERIES), dict(registry.SQL)
