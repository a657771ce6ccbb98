"""Fixed schemas of the canonical tables. ``case_id`` with ``source`` is the key of a scan."""

VOXEL_RUN = "source string, case_id string, organ string, x int, y int, z0 int, z1 int"
CASE_HEADER = ("source string, case_id string, shape array<int>, zooms array<double>, "
               "affine array<array<double>>, voxel_ml double")

RUN_KEY = ["source", "case_id", "organ"]
CASE_KEY = ["source", "case_id"]
