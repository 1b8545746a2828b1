"""Independent DuckDB SQL oracle for every registered query.

It rebuilds the delivery model from the given tables in SQL (see
``fixture_sql``) and answers each query with integer-exact rounding.
"""

from oracle.business_sql import SQL as _BUSINESS
from oracle.star_sql import SQL as _STAR
from oracle.dims_sql import SQL as _DIMS
from oracle.marts_sql import SQL as _MARTS
from oracle.loading_sql import SQL as _LOADING
from oracle.order_sql import SQL as _ORDER
from oracle.sheets_sql import SQL as _SHEETS

ORACLE: dict[str, str] = {}
ORACLE.update(_BUSINESS)
ORACLE.update(_STAR)
ORACLE.update(_DIMS)
ORACLE.update(_MARTS)
ORACLE.update(_LOADING)
ORACLE.update(_ORDER)
ORACLE.update(_SHEETS)
