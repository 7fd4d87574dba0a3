"""Column expressions for semantic items and rule labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The label formats that results must share.
ITEM_SEPARATOR = "="
KEY_SEPARATOR = ","
KEY_ARROW = " => "


def item_token(predicate: Column | str = "predicate", obj: Column | str = "object") -> Column:
    """``predicate=object``, the item an entity's fact becomes."""
    return F.concat_ws(ITEM_SEPARATOR, predicate, obj)


def rule_key(antecedent: Column | str, consequent: Column | str) -> Column:
    """A label for a rule that does not depend on the order of its items."""
    left = F.array_join(F.sort_array(antecedent), KEY_SEPARATOR)
    right = F.array_join(F.sort_array(consequent), KEY_SEPARATOR)
    return F.concat(left, F.lit(KEY_ARROW), right)


def short_label(items: Column | str) -> Column:
    """Each item of an array cut down to the text after its last ``/``."""
    return F.transform(items, lambda item: F.substring_index(item, "/", -1))
