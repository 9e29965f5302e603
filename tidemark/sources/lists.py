"""Sanctions lists: XML files to flat tables, joined into listed entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scoring import mapped
from tidemark.sources.refdata import PROGRAMME_LABELS

LISTED_COLUMNS = ["listed_id", "id_type", "entity_type", "listed_name", "alt_names", "listed_imo", "listed_mmsi", "aircraft_serial", "authority", "regime", "programs"]

# Document types that carry identities, and the sub-types of parties.
DOC_IMO, DOC_MMSI, DOC_SERIAL = "1626", "91264", "1623"
PARTY_TYPES = {"1": "vessel", "2": "aircraft", "3": "entity", "4": "individual"}
_XML = {"ignoreNamespace": "true", "attributePrefix": "_", "valueTag": "_text"}
_c = F.col


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").options(rowTag=row_tag, **_XML).schema(schema).load(path)


_ALIAS = (
    "array<struct<_Primary:string,DocumentedName:array<struct<DocumentedNamePart:array<struct<NamePartValue:struct<_text:string,_ScriptID:string>>>>>>>"
)
PARTY = (
    "_FixedRef string, Profile struct<_ID:string,_PartySubTypeID:string,"
    f"Identity:array<struct<_ID:string,_Primary:string,Alias:{_ALIAS}>>>"
)
DOCUMENT = "_IdentityID string, _IDRegDocTypeID string, IDRegistrationNo string"
BASIS = "_ID string, _LegalBasisShortRef string"
ENTRY = "_ProfileID string, EntryEvent array<struct<_LegalBasisID:string>>"


def program_code(short_ref: Column) -> Column:
    """Topic in trailing parentheses, else the first 32 characters; upper case."""
    topic = F.regexp_extract(short_ref, "\\(([^)]+)\\)\\s*$", 1)
    return F.upper(F.when(topic != "", F.trim(topic)).otherwise(F.substring(F.trim(short_ref), 1, 32)))


def list_a(parties: DataFrame, documents: DataFrame, bases: DataFrame, entries: DataFrame) -> DataFrame:
    """Parties with identities and programs: three joins of flat tables."""
    identity = F.coalesce(
        F.get(F.filter("Profile.Identity", lambda i: i["_Primary"] == "true"), F.lit(0)), F.get(_c("Profile.Identity"), F.lit(0))
    )
    spelled = lambda alias: F.concat_ws(
        " ",
        F.filter(
            F.transform(F.flatten(alias["DocumentedName"]["DocumentedNamePart"]), lambda p: F.trim(p["NamePartValue"]["_text"])),
            lambda s: s != "",
        ),
    )
    aliases = F.flatten(F.transform("Profile.Identity", lambda i: F.coalesce(i["Alias"], F.array().cast(_ALIAS))))
    flat = parties.filter(F.coalesce("_FixedRef", F.lit("")) != "").select(
        _c("_FixedRef").alias("listed_id"), _c("Profile._ID").alias("profile_id"), identity["_ID"].alias("identity_id"),
        mapped(_c("Profile._PartySubTypeID"), PARTY_TYPES, "other").alias("party_type"),
        F.get(F.filter(F.transform(F.filter(aliases, lambda a: a["_Primary"] == "true"), spelled), lambda s: s != ""), F.lit(0)).alias("listed_name"),
        F.array_distinct(
            F.filter(F.transform(F.filter(aliases, lambda a: F.coalesce(a["_Primary"], F.lit("")) != "true"), spelled), lambda s: s != "")
        ).alias("alt_names"),
    )
    number = lambda kind: F.max(F.when(_c("_IDRegDocTypeID") == kind, F.trim("IDRegistrationNo")))
    ids = documents.groupBy(_c("_IdentityID").alias("identity_id")).agg(
        number(DOC_IMO).alias("imo_text"), number(DOC_MMSI).alias("listed_mmsi"), number(DOC_SERIAL).alias("aircraft_serial")
    )
    code = program_code(_c("_LegalBasisShortRef"))
    programs = (
        entries.select(_c("_ProfileID").alias("profile_id"), F.posexplode("EntryEvent").alias("pos", "e"))
        .select("profile_id", "pos", _c("e._LegalBasisID").alias("basis_id"))
        .join(bases.select(_c("_ID").alias("basis_id"), code.alias("code")), "basis_id")
        .filter(_c("code") != "UNKNOWN")
        .groupBy("profile_id", "code").agg(F.min("pos").alias("pos"))
        .groupBy("profile_id").agg(F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("p"))
        .select("profile_id", F.transform("p", lambda x: x["code"]).alias("programs"))
    )
    rows = flat.join(ids, "identity_id", "left").join(programs, "profile_id", "left")
    return rows.select(
        "listed_id", F.lit("ofac_sdn_id").alias("id_type"), F.concat(F.lit("sanctioned_"), "party_type").alias("entity_type"), "listed_name", "alt_names",
        F.nullif(F.regexp_replace("imo_text", "[^0-9]", ""), F.lit("")).alias("listed_imo"), "listed_mmsi", "aircraft_serial",
        F.lit("US Treasury OFAC").alias("authority"), F.get("programs", F.lit(0)).alias("regime"), "programs",
    )


LIST_B = (
    "GroupID string, GroupTypeDescription string, GrpStatus string, name1 string, name2 string, name3 string, name4 string, name5 string, Name6 string, "
    "Ship_IMONumber string, Ship_Flag string, Ship_Type string, RegimeName string, UKSanctionsListRef string"
)


def list_b(targets: DataFrame) -> DataFrame:
    """Active ships; the first row of a group counts (file order)."""
    text = lambda n: F.nullif(F.trim(n), F.lit(""))
    names = F.concat_ws(" ", *[text(n) for n in ("name1", "name2", "name3", "name4", "name5", "Name6")])
    status = F.coalesce(text("GrpStatus"), F.lit("A"))
    ships = targets.filter((F.trim("GroupTypeDescription") == "Ship") & (F.upper(status) == "A") & text("GroupID").isNotNull()).withColumn(
        "_row", F.monotonically_increasing_id()
    )
    rest = [c for c in ships.columns if c not in ("GroupID", "_row")]
    first = ships.groupBy(F.trim("GroupID").alias("listed_id")).agg(F.min_by(F.struct(*rest), "_row").alias("r")).select("listed_id", "r.*")
    return first.select(
        "listed_id", F.lit("uk_ofsi_group_id").alias("id_type"), F.lit("sanctioned_vessel").alias("entity_type"),
        F.coalesce(F.nullif(names, F.lit("")), F.concat(F.lit("UK OFSI "), F.coalesce(text("UKSanctionsListRef"), "listed_id"))).alias("listed_name"),
        F.array().cast("array<string>").alias("alt_names"), F.nullif(F.regexp_replace("Ship_IMONumber", "[^0-9]", ""), F.lit("")).alias("listed_imo"),
        F.lit(None).cast("string").alias("listed_mmsi"), F.lit(None).cast("string").alias("aircraft_serial"), F.lit("UK OFSI").alias("authority"),
        text("RegimeName").alias("regime"), F.array("RegimeName").alias("programs"),
    )


LIST_C = (
    "_logicalId string, _euReferenceNumber string, nameAlias array<struct<_wholeName:string,_nameLanguage:string>>, "
    "identification array<struct<_identificationTypeCode:string,_number:string,_latinNumber:string>>, "
    "regulation array<struct<_programme:string>>"
)


def list_c(entities: DataFrame) -> DataFrame:
    """Entities with an IMO; names in en, fr or de come first, then any."""
    named = F.filter("nameAlias", lambda a: F.trim(a["_wholeName"]) != "")
    preferred = F.filter(named, lambda a: F.lower(F.coalesce(a["_nameLanguage"], F.lit(""))).isin("en", "fr", "de"))
    name = F.coalesce(F.get(preferred, F.lit(0))["_wholeName"], F.get(named, F.lit(0))["_wholeName"])
    numbers = F.transform(
        F.filter("identification", lambda i: F.lower(F.coalesce(i["_identificationTypeCode"], F.lit(""))) == "imo"),
        lambda i: F.regexp_replace(F.coalesce(F.nullif(i["_number"], F.lit("")), i["_latinNumber"], F.lit("")), "[^0-9]", ""),
    )
    imo = F.get(F.filter(numbers, lambda n: n != ""), F.lit(0))
    programme = F.get(_c("regulation"), F.lit(0))["_programme"]
    rest = [c for c in entities.columns if c != "_logicalId"]
    first = entities.filter(F.coalesce("_logicalId", F.lit("")) != "").withColumn("_row", F.monotonically_increasing_id()).groupBy("_logicalId").agg(
        F.min_by(F.struct(*rest), "_row").alias("r")
    ).select("_logicalId", "r.*")
    return first.select(
        _c("_logicalId").alias("listed_id"), F.lit("eu_logical_id").alias("id_type"), F.lit("sanctioned_vessel").alias("entity_type"),
        F.trim(name).alias("listed_name"), F.array_distinct(F.transform(named, lambda a: F.trim(a["_wholeName"]))).alias("alt_names"), imo.alias("listed_imo"),
        F.lit(None).cast("string").alias("listed_mmsi"), F.lit(None).cast("string").alias("aircraft_serial"), F.lit("EU CFSP").alias("authority"),
        F.coalesce(mapped(programme, PROGRAMME_LABELS, None), programme).alias("regime"), F.array(programme).alias("programs"),
    ).filter(_c("listed_imo").isNotNull())
