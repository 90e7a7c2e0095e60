from .tables import TableSet, read_table  # noqa: F401
from .derived import Views  # noqa: F401
