"""Column names of the data model and the accepted source names."""

from __future__ import annotations

# Canonical names and the source names that stand for them (lower case).
SOURCE_NAMES: dict[str, list[str]] = {
    "hole_id": ["hole_id", "holeid", "hole id", "hole-id"],
    "datasource_hole_id": ["datasource_hole_id", "datasourceholeid", "datasource hole id", "datasource-hole-id", "company_hole_id",
    "companyholeid", "company hole id", "company-hole-id"],
    "project_id": ["project_id", "projectid", "project id", "project-id", "project_code", "projectcode", "project code", "project-code",
    "company_id", "companyid", "company id", "company-id", "dataset", "project"],
    "latitude": ["latitude", "lat"],
    "longitude": ["longitude", "lon"],
    "elevation": ["elevation", "rl", "elev", "z"],
    "easting": ["easting", "x"],
    "northing": ["northing", "y"],
    "crs": ["crs", "epsg", "projection"],
    "from": ["from", "depth_from", "from_depth", "samp_from", "sample_from", "sampfrom", "fromdepth"],
    "to": ["to", "depth_to", "to_depth", "samp_to", "sample_to", "sampto", "todepth"],
    "geology_code": ["geology_code", "geologycode", "lith1", "lith1code", "lith1_code", "lithology", "plot_lithology", "rock1"],
    "azimuth": ["azimuth", "az", "dip_direction", "dipdir", "dip direction", "dipdrn", "dipdirection", "dip_dir", "computed_plane_azimuth",
    "calc_dipdir", "calc_dipdir_deg", "dipdir_calc", "dipdirect_calc"],
    "dip": ["dip", "computed_plane_dip", "calc_dip", "calc_dip_deg", "dip_calc"],
    "depth": ["depth", "survey_depth", "surveydepth"],
    "alpha": ["alpha", "alpha_angle", "alpha_angle_deg", "alpha_2"],
    "beta": ["beta", "beta_angle", "beta_angle_deg", "beta_2"],
    "declination": ["declination", "dec"],
    "comments": ["comment", "comments", "structcomment", "geology_comment", "geologycomment", "geology comment", "lithology_comment",
    "lithology comment", "geology_description", "geologydescription"],
}
# What differs in the other dialect of names, which keeps descriptions apart from comments and knows strikes.
DESCRIPTIONS = ["geology_description", "geologydescription", "geology_comment", "geologycomment", "geology comment", "lithology_comment",
    "lithology comment", "description", "comments"]
STRIKES = ["strike", "str"]
# The same for block models.
BLOCK_SOURCE_NAMES: dict[str, list[str]] = {
    "x": ["x", "easting", "center_x", "xc", "xcentre", "xcenter", "x_centre", "x_center", "cx"],
    "y": ["y", "northing", "center_y", "yc", "ycentre", "ycenter", "y_centre", "y_center", "cy"],
    "z": ["z", "elevation", "center_z", "zc", "zcentre", "zcenter", "z_centre", "z_center", "cz"],
    "dx": ["dx", "size_x", "sx", "sizex", "dim_x", "block_size_x"],
    "dy": ["dy", "size_y", "sy", "sizey", "dim_y", "block_size_y"],
    "dz": ["dz", "size_z", "sz", "sizez", "dim_z", "block_size_z"],
}
# Canonical columns of each table.
GEOMETRY = ["x", "y", "z", "dx", "dy", "dz"]
COLLAR = ["hole_id", "datasource_hole_id", "project_id", "latitude", "longitude", "elevation", "easting", "northing", "crs"]
SURVEY = ["hole_id", "depth", "to", "azimuth", "dip"]
STRUCTURE = ["hole_id", "depth", "dip", "azimuth", "alpha", "beta", "comments"]
ASSAY = ["hole_id", "from", "to", "mid"]
GEOLOGY = ["hole_id", "from", "to", "mid", "geology_code", "comments"]
GEOTECHNICAL = ["rqd", "fracture_count", "fracture_frequency", "core_recovery", "tce"]
# Texts that stand for a missing value.
MISSING = ["", "nan", "null", "none"]
#: Order in which rows of a source came; attached when it is read, dropped by no operator.
ROW = "_row_id"
