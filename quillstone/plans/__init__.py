"""Query plans over the star schema; importing this package registers them."""
from . import analytics, basic, joins, search, windows  # noqa: F401
