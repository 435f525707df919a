"""Sources, layers, features and models that the pipeline knows."""

from __future__ import annotations

from dataclasses import dataclass

ACCESS_MODES = ("datastore", "bulk_csv")


@dataclass(frozen=True)
class SourceConfig:
    """One open-data dataset and how to fetch it."""

    dataset_id: str
    access_mode: str
    year_start: int = 2015
    year_column: str = "application_date"

    def __post_init__(self):
        if self.access_mode not in ACCESS_MODES:
            raise ValueError(f"access_mode must be one of {', '.join(ACCESS_MODES)}, not {self.access_mode!r}")


# The datasets.
SOURCE_CONFIGS: dict[str, SourceConfig] = {
    "permits_active": SourceConfig("building-permits-active-permits", "datastore", 2020),
    "permits_cleared": SourceConfig("building-permits-cleared-permits", "datastore", 2020),
    "coa": SourceConfig("committee-of-adjustment-applications", "bulk_csv", 2020),
    "dev_applications": SourceConfig("development-applications", "datastore", 2000, "date_submitted"),
}

# Where the datasets and the reference layers are published.
PORTAL = "https://ckan0.cf.opendata.inter.prod-toronto.ca"
LAYER_URLS: dict[str, str] = {
    "zoning": f"{PORTAL}/datastore/dump/76a2620f-a6b4-495d-8e41-c0ede1f8a928",
    "heritage_register": f"{PORTAL}/dataset/e41da515-5ad1-4bc3-85ea-18ec9e55cd33/resource/108b1080-d048-439f-a9e8-e8d6cd81bddb/download/heritage_register_address_points_wgs84.zip",
    "heritage_districts": f"{PORTAL}/dataset/37a3c911-0813-4e87-90ed-3b9fa6156a63/resource/8e6b9347-63a8-4dac-91fb-a6491a8c1e5a/download/heritageconservationdistrict.zip",
    "secondary_plans": f"{PORTAL}/dataset/70a544e9-ee83-43a4-b0be-0dc973627ad7/resource/08099a8c-a598-4ca3-8395-e4159cc1ec1a/download/secondary-plans-data-2017-4326.geojson",
}

# Features, in the order of the models' inputs.
DEV_CAT_COLS = ["application_type", "ward_number", "zoning_class", "secondary_plan_name"]
DEV_NUM_COLS = ["year_submitted", "in_heritage_register", "in_heritage_district", "in_secondary_plan", "has_community_meeting"]
COA_CAT_COLS = ["application_type", "sub_type", "ward_number", "zoning_designation"]
COA_NUM_COLS = ["year_submitted"]

# Outcome words, stripped and in lower case.
DEV_APPROVED = ["closed", "noac issued", "council approved", "draft plan approved", "final approval completed", "omb approved", "approved", "omb partially approved"]
DEV_REFUSED = ["refused", "omb refused"]
DEV_APPEALED = ["omb appeal", "appeal received", "omb approved", "omb refused", "omb partially approved"]
COA_APPROVED = ["approved", "conditional approval", "approved with conditions", "approved on condition"]
COA_REFUSED = ["refused", "withdrawn"]


@dataclass(frozen=True)
class ModelSpec:
    """One model: its enriched table, label and features; a regressor has no probability."""

    name: str
    source: str
    label: str
    cat_cols: tuple[str, ...]
    num_cols: tuple[str, ...]
    regression: bool = False

    @property
    def features(self) -> list[str]:
        return [*self.cat_cols, *self.num_cols]

    @property
    def metric(self) -> str:
        return "r2" if self.regression else "roc_auc"


def _specs() -> dict[str, ModelSpec]:
    dev, coa = (tuple(DEV_CAT_COLS), tuple(DEV_NUM_COLS)), (tuple(COA_CAT_COLS), tuple(COA_NUM_COLS))
    rows = [
        ModelSpec("dev_applications_approved", "dev_applications", "dev_approved", *dev),
        # The label is 1 where an appeal was filed, in spite of its name.
        ModelSpec("dev_applications_no_appeal", "dev_applications", "dev_no_appeal", *dev),
        ModelSpec("coa_approved", "coa", "coa_approved", *coa),
        ModelSpec("coa_days_to_approval", "coa", "coa_days_to_approval", *coa, regression=True),
    ]
    return {m.name: m for m in rows}


MODELS: dict[str, ModelSpec] = _specs()
