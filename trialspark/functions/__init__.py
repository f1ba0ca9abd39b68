"""Column-expression helpers (JVM-side, codegen friendly) and the study's fixed values."""

from trialspark.functions import codes, dates  # noqa: F401
