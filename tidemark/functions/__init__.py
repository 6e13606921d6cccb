"""Column expressions. Everything here stays inside whole-stage code generation."""

from tidemark.functions.expressions import *  # noqa: F401,F403
from tidemark.functions.text import *  # noqa: F401,F403
