"""Schemas of the tables that kernels give."""

ATTR = "struct<ns:string,name:string,value:string>"
TOKENS = f"page_id long, pos int, kind string, name string, data string, self_closing boolean, attrs array<{ATTR}>, public_id string, system_id string, force_quirks boolean"
#: last: the last descendant's node_id; path: node_ids of the ancestors in the same tree; elem_* and type_*: place among element siblings, from 1.
NODES = (
    "page_id long, node_id int, parent_id int, tree_root int, depth int, last int, path array<int>, kind string, ns string, name string, name_lc string, text string, "
    f"id string, classes array<string>, attrs map<string,string>, attr_list array<{ATTR}>, child_idx int, elem_idx int, elem_count int, type_idx int, type_count int, "
    "is_root boolean, is_empty boolean, host_id int, quirks string, shadow_mode string"
)
CSS_TOKENS = "sheet_id long, pos int, kind string, value string, num double, is_integer boolean, unit string, start int, end int"
RULES = "sheet_id long, rule int, selector int, selector_text string, a int, b int, c int, key_kind string, key string"
DECLARATIONS = "sheet_id long, rule int, decl int, name string, value string, important boolean, what string, longhands array<struct<name:string,kind:string,value:string>>"
COMPUTED = "page_id long, node_id int, property string, kind string, px double, pct double, num double, text string"
BOXES = "page_id long, box_id int, parent_box int, node_id int, kind string, tag string, x double, y double, w double, h double, margin array<double>, border array<double>, padding array<double>"
FACES = "path string, face int, family string, subfamily string, weight int, italic boolean, units_per_em int, ascender int, descender int, line_gap int, glyphs int"
