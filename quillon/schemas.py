"""Tables of the model."""

from __future__ import annotations

STANDARDS = "id long, std_id string, std_type string, std_chinesename string, std_status string, ex_state int, release_date string, implement_date string, std_id_norm string, std_id_compact string"
FILES = "id long, base_id long, file_path string, file_name string, file_size long"
AREAS = "area_code string, province_name string, city_name string, county_name string, level int"
UNITS = "unit_id long, unit_name string, area_code string"
RELATIONS = "id long, base_id long, unit_id long, role_type int, rank_order int"
GEO = "base_id long, unit_id long, unit_name string, province_name string, city_name string, county_name string, area_code string"
CATALOG = "id long, filename string, category string, title string, file_ext string, file_size long, mtime double, rel_path string"
CLUSTERS = "id string, name string, keywords array<string>"

#: Columns of a dump's tuples by position: name -> place; a tuple with fewer fields than ``least`` is skipped.
DUMP_FIELDS: dict[str, tuple[int, dict[str, int]]] = {
    "std_base": (12, {"id": 0, "std_id": 1, "std_type": 2, "std_chinesename": 5, "release_date": 7, "implement_date": 8, "std_status": 10, "ex_state": 11}),
    "std_filepath": (5, {"id": 0, "base_id": 1, "file_path": 2, "file_name": 3, "file_size": 5}),
    "area_dict": (5, {"area_code": 0, "province_name": 1, "city_name": 2, "county_name": 3, "level": 4}),
    "unit_dict": (3, {"unit_id": 0, "unit_name": 1, "area_code": 2}),
    "std_unit_relation": (3, {"id": 0, "base_id": 1, "unit_id": 2, "role_type": 3, "rank_order": 4}),
}
