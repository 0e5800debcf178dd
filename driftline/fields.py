"""Names and constants of the occurrence data model.

Everything in this module is a fixed value: the data, the published results
and the exported files use exactly these names, numbers and patterns.
"""

# ---- fixed values: top-level columns of an occurrence file ----------------
OCCURRENCE_COLUMNS = [
    "_id", "_event_id", "_occurrence_id", "dataset_id", "node_ids",
    "source", "interpreted", "extensions",
    "missing", "invalid", "flags", "dropped", "absence", "tags", "geometry",
]

# ``source`` and ``extensions`` differ from file to file and are not carried into splits.
UNSTABLE_COLUMNS = ["source", "extensions"]
SPLIT_COLUMNS = [c for c in OCCURRENCE_COLUMNS if c not in UNSTABLE_COLUMNS]

# ---- fixed values: fields of ``interpreted`` that a complete record has ----
CORE_FIELDS = [
    "samplingProtocol", "bathymetry", "shoredistance",
    "decimalLatitude", "decimalLongitude", "geodeticDatum",
    "kingdom", "phylum", "class", "order", "family", "genus", "species",
    "scientificName", "occurrenceID",
]

# ---- fixed values: the twelve features whose distribution is compared ------
NUMERIC_FIELDS = ["bathymetry", "shoredistance", "decimalLatitude", "decimalLongitude"]
CATEGORICAL_FIELDS = [
    "samplingProtocol", "kingdom", "phylum", "class", "order", "family", "genus", "species",
]

# ---- fixed values: fields of ``source`` compared by the file-list check ----
RAW_NUMERIC_FIELDS = [
    "decimalLatitude", "decimalLongitude", "minimumDepthInMeters",
    "maximumDepthInMeters", "coordinateUncertaintyInMeters",
]
RAW_CATEGORICAL_FIELDS = ["basisOfRecord", "kingdom", "phylum", "class", "order", "family"]

# ---- fixed values: splits, in order, with the first bucket past each -------
SPLITS = ("train", "dev", "test")
SPLIT_UPPER_BUCKETS = {"train": 80, "dev": 90, "test": 100}
FILE_LIST_SPLITS = ("train", "val", "test")

# ---- fixed values: GeoJSON property <- interpreted field -------------------
GEOJSON_PROPERTIES = {
    "species": "scientificName",
    "depth": "depth",
    "bathymetry": "bathymetry",
    "phylum": "phylum",
    "class": "class",
    "order": "order",
    "family": "family",
    "habitat": "habitat",
    "waterBody": "waterBody",
}

# ---- fixed values: map colours --------------------------------------------
PHYLUM_COLOURS = {
    "Chordata": "#e74c3c",
    "Arthropoda": "#e67e22",
    "Mollusca": "#f1c40f",
    "Cnidaria": "#9b59b6",
    "Echinodermata": "#1abc9c",
    "Annelida": "#2ecc71",
    "Bryozoa": "#3498db",
    "Porifera": "#e84393",
    "Rhodophyta": "#d63031",
    "Ochrophyta": "#6c5ce7",
}
OTHER_PHYLUM_COLOUR = "#7f8c8d"

# ---- fixed values: marks of the cumulative vocabulary report ---------------
CUMULATIVE_MARKS = (1, 50, 100, 500, 1000, 5000, 10000)

# ---- fixed values: URL patterns (whole string, any case) -------------------
STRICT_URL = (
    r"^https?://[-a-zA-Z0-9@:%._\+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b"
    r"([-a-zA-Z0-9()@:%_\+.~#?&//=]*)$"
)
LOOSE_URL = (
    r"^(https?://)?(www\.)?[-a-zA-Z0-9@:%._\+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b"
    r"([-a-zA-Z0-9()@:%_\+.~#?&//=]*)$"
)
DOI_PREFIX = r"^doi:10\."

# ---- fixed values: notes of the URL outcome table --------------------------
NOTE_RENDER_FAILED = "failed to read site content"
NOTE_NO_CONTENT = "failed to download site content"
NOTE_NO_TEXT = "failed to extract markdown from downloaded site content"
NOTE_OK = ""

# ---- fixed values: Darwin Core terms of the coverage report, by category ---
TERM_CATEGORIES = {
    "Record": """
        basisOfRecord occurrenceID occurrenceStatus occurrenceRemarks catalogNumber recordNumber
        recordedBy recordedByID individualCount organismQuantity organismQuantityType sex lifeStage
        reproductiveCondition caste behavior vitality disposition preparations associatedMedia
        associatedOccurrences associatedReferences associatedSequences associatedTaxa
        otherCatalogNumbers previousIdentifications type typeStatus modified language license
        accessRights rightsHolder bibliographicCitation references informationWithheld
        dataGeneralizations datasetID datasetName collectionCode collectionID institutionCode
        institutionID ownerInstitutionCode
    """.split(),
    "Organism": """
        organismID organismName organismRemarks organismScope associatedOrganisms
        degreeOfEstablishment establishmentMeans pathway
    """.split(),
    "Event": """
        eventID parentEventID eventDate eventTime eventType eventRemarks fieldNotes fieldNumber
        verbatimEventDate year month day startDayOfYear endDayOfYear samplingProtocol samplingEffort
        sampleSizeValue sampleSizeUnit
    """.split(),
    "Location": """
        continent country countryCode stateProvince county municipality island islandGroup waterBody
        locality verbatimLocality locationID locationRemarks locationAccordingTo higherGeography
        higherGeographyID
    """.split(),
    "Coordinates": """
        decimalLatitude decimalLongitude geodeticDatum coordinateUncertaintyInMeters
        coordinatePrecision verbatimLatitude verbatimLongitude verbatimCoordinates
        verbatimCoordinateSystem verbatimSRS footprintWKT footprintSRS footprintSpatialFit
        pointRadiusSpatialFit georeferenceProtocol georeferenceSources georeferenceRemarks
        georeferenceVerificationStatus georeferencedBy georeferencedDate
    """.split(),
    "Depth & Elevation": """
        minimumDepthInMeters maximumDepthInMeters verbatimDepth minimumElevationInMeters
        maximumElevationInMeters verbatimElevation minimumDistanceAboveSurfaceInMeters
        maximumDistanceAboveSurfaceInMeters verticalDatum
    """.split(),
    "Habitat": ["habitat"],
    "Taxonomy": """
        kingdom phylum class order family subfamily superfamily tribe subtribe genus subgenus
        genericName specificEpithet infraspecificEpithet infragenericEpithet cultivarEpithet
        scientificName scientificNameAuthorship scientificNameID acceptedNameUsage
        acceptedNameUsageID originalNameUsage originalNameUsageID parentNameUsage parentNameUsageID
        nameAccordingTo nameAccordingToID namePublishedIn namePublishedInID namePublishedInYear
        higherClassification taxonID taxonConceptID taxonRank verbatimTaxonRank taxonRemarks
        taxonomicStatus nomenclaturalCode nomenclaturalStatus vernacularName verbatimIdentification
    """.split(),
    "Identification": """
        identificationID identifiedBy identifiedByID dateIdentified identificationRemarks
        identificationQualifier identificationReferences identificationVerificationStatus
    """.split(),
    "Geological": """
        geologicalContextID group formation member bed earliestEonOrLowestEonothem
        latestEonOrHighestEonothem earliestEraOrLowestErathem latestEraOrHighestErathem
        earliestPeriodOrLowestSystem latestPeriodOrHighestSystem earliestEpochOrLowestSeries
        latestEpochOrHighestSeries earliestAgeOrLowestStage latestAgeOrHighestStage
        lowestBiostratigraphicZone highestBiostratigraphicZone lithostratigraphicTerms
    """.split(),
    "Material": "materialEntityID materialEntityRemarks materialSampleID".split(),
    "Other": "dynamicProperties verbatimLabel".split(),
}
TERMS = [term for terms in TERM_CATEGORIES.values() for term in terms]
