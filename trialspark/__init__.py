"""trialspark: target-trial emulation on dated patient records, as Spark plans."""

from trialspark.params import AS_DOCUMENTED, AS_WRITTEN, FIXTURE_PARAMS, StudyParams  # noqa: F401

__version__ = "0.1.0"
