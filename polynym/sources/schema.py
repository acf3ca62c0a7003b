"""Schemas of records, pairs and reports."""

ENTITY = "id string, name string, lang string, entity_type string, aliases array<string>"
SITELINK = "qid string, l1_title string, l2_title string, wikidata_type string, type_label string, bucket string"
# The type buckets in the order in which they are extracted.
TYPE_BUCKETS = (
    ("Q5", "person"),
    ("Q43229", "organization"),
    ("Q515", "city"),
    ("Q6256", "country"),
    ("Q11424", "film"),
    ("Q571", "book"),
    ("Q11173", "chemical"),
    ("Q838948", "work_of_art"),
    ("Q15089776", "event"),
    ("Q4830453", "business"),
)
