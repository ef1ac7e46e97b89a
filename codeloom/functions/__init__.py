"""Column functions of the engine: all run inside the JVM, without Python workers."""

from codeloom.functions.scalars import *  # noqa: F403
