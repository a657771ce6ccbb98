"""Fixed values shared with the collections: class names, label ids, folders, thresholds."""

# Target classes and their ids (0 is background).
ORGAN_IDS = {"adrenal_left": 1, "adrenal_right": 2, "kidney_left": 3, "kidney_right": 4, "liver": 5, "spleen": 6,
             "aorta": 7, "inferior_vena_cava": 8, "pancreas": 9}
GLANDS = ["adrenal_left", "adrenal_right"]
OTHER_ORGANS = [o for o in ORGAN_IDS if o not in GLANDS]

# (left organ, right organ): the first must lie on the patient's left of the second.
SIDE_PAIRS = [("adrenal_left", "adrenal_right"), ("kidney_left", "kidney_right"), ("spleen", "liver")]

# Later entries win where masks overlap.
WRITE_ORDER = ["liver", "spleen", "kidney_left", "kidney_right", "aorta", "inferior_vena_cava", "pancreas",
               "adrenal_left", "adrenal_right"]

# Mask-per-structure source: structures that make up each organ.
STRUCTURES = {"adrenal_left": ["adrenal_gland_left"], "adrenal_right": ["adrenal_gland_right"],
              "kidney_left": ["kidney_left", "kidney_cyst_left"],
              "kidney_right": ["kidney_right", "kidney_cyst_right"],
              "liver": ["liver"], "spleen": ["spleen"], "aorta": ["aorta"],
              "inferior_vena_cava": ["inferior_vena_cava"], "pancreas": ["pancreas"]}

# Label-file sources: integer id of each organ.
LABEL_IDS = {
    "amos": {"spleen": 1, "kidney_right": 2, "kidney_left": 3, "liver": 6, "aorta": 8, "inferior_vena_cava": 9,
             "pancreas": 10, "adrenal_right": 11, "adrenal_left": 12},
    "btcv": {"spleen": 1, "kidney_right": 2, "kidney_left": 3, "liver": 6, "aorta": 8, "inferior_vena_cava": 9,
             "pancreas": 11, "adrenal_right": 12, "adrenal_left": 13},
    "flare": {"liver": 1, "kidney_right": 2, "spleen": 3, "pancreas": 4, "aorta": 5, "inferior_vena_cava": 6,
              "adrenal_right": 7, "adrenal_left": 8, "kidney_left": 13}}
RAOS_LABEL_IDS = {"adrenal_left": 13, "adrenal_right": 12, "kidney_left": 3, "kidney_right": 4, "liver": 1,
                  "spleen": 2, "pancreas": 8}

# (source, folder of label files, split its authors gave them)
LABEL_FOLDERS = [("amos", "train/labelsTr", "train"), ("amos", "valid/labelsVa", "val"),
                 ("btcv", "RawData/Training/label", "train"), ("flare", "labels", "train")]

# Organ names another model may use instead of ours.
ORGAN_ALIASES = {"adrenal_left": ["adrenal_left", "adrenal_gland_left"],
                 "adrenal_right": ["adrenal_right", "adrenal_gland_right"],
                 "inferior_vena_cava": ["inferior_vena_cava", "postcava"]}

SPECKLE_ML, MINIMUM_ML, MAX_SLICE_MM = 0.3, 1.0, 5.0
TOLERANCES_MM = [0.5, 0.8, 1.0]
MAX_CHANGED_FRACTION = 1e-4
SPLIT_SEED, FOLDS, MINIMUM_GROUP = 12345, 5, 10
OUTSIDE_SPLIT = "excluded_from_dataset902"
SAME_SHAPE_R, ANY_SHAPE_R = 0.97, 0.99

EVIDENCE_STATUS = {"exact": "standardized_image_hash_match", "shape+corr": "shape_and_correlation_candidate",
                   "corr-only": "correlation_only_candidate"}
EXPECTED_SCANS = {"amos": 300, "btcv": 30, "flare": 50}
TRAIN_SUFFIXES = ["{config}/{name}.b2nd", "{config}/{name}_seg.b2nd", "{config}/{name}.pkl",
                  "gt_segmentations/{name}.nii.gz"]
TEST_SUFFIXES = ["imagesTs/{name}_0000.nii.gz", "labelsTs/{name}.nii.gz"]

# Fixed texts of the provenance table.
OWN_LABELS = "no (own labels)"
OUTSIDE_BUILD = "excluded (fragmented, left/right or > 5 mm)"

# Organs of the focus report.
FOCUS = ["adrenal_left", "adrenal_right", "aorta", "pancreas", "liver"]
