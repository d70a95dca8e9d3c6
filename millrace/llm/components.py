"""Connected components: those of the library's graph operators, under the name that this subpackage uses."""

from ..operators.graph import Forest, components  # noqa: F401
