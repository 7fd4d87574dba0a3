from .items import item_token, rule_key, short_label
from .literals import escape_literal, unescape_literal

__all__ = ["escape_literal", "item_token", "rule_key", "short_label", "unescape_literal"]
