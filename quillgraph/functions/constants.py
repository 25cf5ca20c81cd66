"""Tables, thresholds and word lists whose content determines results."""

from __future__ import annotations

#: Biolink type by ontology.
BIOLINK_BY_ONTOLOGY = {"mondo": "Disease", "doid": "Disease", "hp": "PhenotypicFeature", "chebi": "ChemicalSubstance", "cl": "Cell",
                       "uberon": "OrganismalEntity"}
#: Words in a term name that tell its kind in the gene ontology, in order.
GO_KINDS = [(("process", "pathway"), "BiologicalProcess"), (("activity", "function"), "MolecularActivity"), (("component", "complex"), "CellularComponent")]
#: Ontologies accepted for an entity type.
TYPE_ONTOLOGIES = {"disease": ["mondo", "doid"], "chemical": ["chebi"], "drug": ["chebi"], "gene": ["hgnc", "ensembl"], "protein": ["uniprot"],
                   "phenotype": ["hp"], "anatomy": ["uberon"], "cell": ["cl"], "process": ["go"]}
#: Abbreviations expanded before an entity is compared.
ENTITY_ABBREVIATIONS = {"mi": "myocardial infarction", "dm": "diabetes mellitus", "cad": "coronary artery disease", "cvd": "cardiovascular disease"}
#: Predicates that count as one in the evaluation.
EVAL_PREDICATES = {"causes": "causes", "leads_to": "causes", "results_in": "causes", "associated_with": "associated_with", "correlated_with": "associated_with",
                   "treats": "treats", "therapy_for": "treats", "increases_risk_for": "increases_risk_for", "risk_factor_for": "increases_risk_for"}
#: Predicates of an extractor and their standard form, in order of precedence.
EXTRACTOR_PREDICATES = {
    "causes": ["cause", "leads to", "results in", "induces", "triggers"],
    "treats": ["treat", "therapy for", "used for", "reduces"],
    "increases_risk_for": ["risk factor for", "increases risk of", "predisposes to"],
    "decreases_risk_for": ["protective against", "reduces risk of"],
    "biomarker_for": ["marker for", "indicator of", "diagnostic for"],
    "association": ["linked to", "correlated with", "related to", "associated_with", "is associated with"],
    "variant": ["is a variant"],
    "positive_correlation": ["positively correlated with"],
    "negative_correlation": ["negatively correlated with"],
    "bind": ["binds"],
}
#: Relation ontology ids of predicates.
PREDICATE_RO = {"treats": "0002606", "causes": "0002410", "association": "0002327", "bind": "0002434", "comparison": "0002502", "conversion": "0002449",
                "cotreatment": "0002460", "drug_interaction": "0002436", "negative_correlation": "0002608", "positive_correlation": "0002607"}
RO_BASE = "http://purl.obolibrary.org/obo/RO_"
#: Identifier prefixes accepted on both sides of a predicate where the ontology is silent.
_CHEM = ["CHEBI_", "DRUGBANK_", "ChEMBL"]
_BROAD = ["CHEBI_", "PR_", "MONDO_", "DOID_", "HP_", "EFO_", "OMIM"]
PREFIX_SCHEMA = {
    "treats": (["CHEBI_", "DRUGBANK_", "ChEMBL", "NCIT_C", "PR_"], ["MONDO_", "DOID_", "HP_", "EFO_", "OMIM"]),
    "causes": (["CHEBI_", "PR_", "MONDO_", "HP_"], ["MONDO_", "HP_"]),
    "association": (_BROAD, _BROAD), "positive_correlation": (_BROAD, _BROAD), "negative_correlation": (_BROAD, _BROAD),
    "drug_interaction": (_CHEM, _CHEM), "cotreatment": (_CHEM, _CHEM),
    "bind": (["CHEBI_", "PR_", "NCIT_C"], ["CHEBI_", "PR_", "NCIT_C"]), "conversion": (["CHEBI_", "ChEMBL"], ["CHEBI_", "ChEMBL"]),
}
#: Prefixes for schemas read from restrictions: ranges, chemicals (either side), symmetric predicates.
RANGE_MARKS = ["MONDO_", "DOID_", "HP_", "EFO_", "OMIM", "Orphanet", "phenotypicSeries"]
CHEMICAL_MARKS = ["CHEBI_", "PR_", "NCIT_C", "DRUGBANK_", "UNII", "ChEMBL", "CHEMBL"]
SYMMETRIC_MARKS = ["CHEBI_", "PR_", "NCIT_C", "DRUGBANK_", "ChEMBL", "MONDO_", "DOID_", "HP_", "EFO_", "OMIM"]
SYMMETRIC_WORDS = ["correlation", "associated", "interaction"]
#: Verification thresholds and evidence scores.
ACCEPT, EXTRA_ROUNDS = 0.70, 2
SCORE_ASK, SCORE_NO_ASK, SCORE_NONE, SCORE_CAP, SCORE_BASE, SCORE_STEP, SCORE_CONSISTENT = 0.95, 0.2, 0.15, 0.85, 0.4, 20.0, 0.9
#: Result limits of the evidence queries.
LIMIT_TWOHOP, LIMIT_FLEXIBLE, LIMIT_RESOLVER, LIMIT_DETAILS, LIMIT_NEIGHBOURS, LIMIT_RELATED, LIMIT_PATHS = 200, 120, 120, 10, 50, 20, 10
#: Weight of an ontology in ranking term candidates by degree.
MAPPING_WEIGHTS = {"DOID": 3, "CHEBI": 2, "RO": -1, "GO": 4, "CL": 3, "FMA": 2, "MONDO": -1}
#: Associations between classes, in order of precedence: (name, subject classes, object classes).
_ANATOMY = ["OrganismalEntity", "Cell", "CellularComponent"]
_PHENO = ["Disease", "PhenotypicFeature"]
ASSOCIATIONS = [
    ("AnatomicalEntityToAnatomicalEntityAssociation", _ANATOMY, _ANATOMY),
    ("ChemicalToDiseaseOrPhenotypicFeatureAssociation", ["ChemicalSubstance"], _PHENO),
    ("ChemicalToGeneAssociation", ["ChemicalSubstance"], ["Gene"]),
    ("ChemicalToThingAssociation", ["ChemicalSubstance"], ["NamedThing"]),
    ("GeneToGeneAssociation", ["Gene"], ["Gene"]),
    ("GeneToThingAssociation", ["Gene"], ["NamedThing"]),
    ("ThingToDiseaseOrPhenotypicFeatureAssociation", ["NamedThing"], _PHENO),
    ("DiseaseOrPhenotypicFeatureAssociationToThingAssociation", _PHENO, ["NamedThing"]),
]
#: Class of a term by ontology prefix or namespace.
CLASS_TABLE = [
    ("OrganismalEntity", ["FMA", "ZEBRAFISH_ANATOMICAL_ONTOLOGY", "UBERON"]), ("Cell", ["CL"]),
    ("CellularComponent", ["CellularComponent", "cellular_component"]), ("BiologicalProcess", ["BiologicalProcess", "biological_process"]),
    ("MolecularActivity", ["MolecularFunction", "molecular_function"]), ("Disease", ["DOID"]), ("PhenotypicFeature", ["HUMAN_PHENOTYPE", "CMPO"]),
    ("ChemicalSubstance", ["CHEBI"]),
]
#: Relations followed first, and relations that raise a path's score.
PRIORITY_RELATIONS = ["treats", "causes", "prevents", "interacts_with", "regulates", "part_of", "has_mechanism", "targets"]
BONUS_RELATIONS = ["treats", "causes", "regulates", "interacts_with", "part_of"]
#: Dependency labels and negations of subject-verb-object extraction.
SUBJECT_DEPS = ["nsubj", "nsubjpass", "csubj", "csubjpass", "agent", "expl"]
OBJECT_DEPS = ["dobj", "dative", "attr", "oprd", "pobj", "nmod"]
NEGATIONS = ["no", "not", "n't", "never", "none"]
#: Predicates that carry labels in a triple store.
LABEL_PREDICATES = ["rdfs:label", "oboInOwl:hasExactSynonym", "skos:altLabel"]
#: Defaults of the latent subgraph.
SUBGRAPH = {"seed_top_k": 50, "hops": 2, "alpha": 0.2, "final_k": 200, "w_text": 0.6, "w_ppr": 0.4, "seed_bonus": 0.05}
#: Core properties of an ontology-service node; all others are annotations.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "in", "is", "it", "its", "of", "on", "or", "that", "the", "to", "was",
              "were", "with"]
