"""Column functions (JVM-side expressions only)."""

from expkit.functions.columns import *  # noqa: F401,F403
