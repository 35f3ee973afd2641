from topicspark.functions.json_values import json_field, json_text, json_value
from topicspark.functions.match import match_path, value_format, value_matches
from topicspark.functions.xml_values import xml_children, xml_extract, xml_extract_all, xml_ok, xml_text

__all__ = [
    "json_field",
    "json_text",
    "json_value",
    "match_path",
    "value_format",
    "value_matches",
    "xml_children",
    "xml_extract",
    "xml_extract_all",
    "xml_ok",
    "xml_text",
]
