"""Fixes by framework: which framework issued the calls of a finding, and what helps there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names in instrumentation scopes, more specific ones first.
SCOPE_RULES = (
    ("java_quarkus_reactive", ("hibernate-reactive", "io.quarkus.hibernate.reactive", "io.quarkus.panache.reactive", "io.quarkus.reactive")),
    ("java_quarkus", ("quarkus",)),
    ("java_webflux", ("spring-webflux", "r2dbc")),
    ("java_jpa", ("spring-data", "hibernate")),
    ("java_helidon_se", ("helidon",)),
    ("csharp_ef_core", ("entityframeworkcore",)),
    ("ruby_active_record", ("activerecord", "active-record", "active_record")),
    ("php_laravel_eloquent", ("laravel",)),
    ("php_doctrine", ("doctrine",)),
    ("python_django", ("django",)),
    ("python_sqlalchemy", ("sqlalchemy",)),
)
# Parts of code namespaces, more specific ones first.
NAMESPACE_RULES = (
    ("java_helidon_mp", ("io.helidon.microprofile",)),
    ("java_helidon_se", ("io.helidon",)),
    ("java_quarkus_reactive", ("io.quarkus.hibernate.reactive", "io.quarkus.panache.reactive", "io.quarkus.reactive", "org.hibernate.reactive", "io.smallrye.mutiny")),
    ("java_quarkus", ("io.quarkus",)),
    ("java_webflux", ("org.springframework.web.reactive", "reactor.core")),
    ("java_jpa", ("jakarta.persistence", "javax.persistence", "org.hibernate", "org.springframework.data.jpa")),
    ("csharp_ef_core", ("Microsoft.EntityFrameworkCore", "Pomelo.EntityFrameworkCore")),
    ("python_django", ("django",)),
    ("python_sqlalchemy", ("sqlalchemy",)),
    ("rust_diesel", ("diesel::",)),
    ("rust_sea_orm", ("sea_orm::",)),
    ("go_gorm", ("gorm",)),
    ("node_prisma", ("prisma",)),
    ("php_laravel_eloquent", ("Illuminate\\Database\\Eloquent", "App\\Models")),
    ("php_doctrine", ("Doctrine\\ORM", "Doctrine\\DBAL")),
)
# Languages by file ending, and names in service names as the last hint.
EXTENSIONS = {"java": "java_generic", "kt": "java_generic", "cs": "csharp_generic", "py": "python_generic", "rb": "ruby_active_record", "go": "go_generic", "js": "node_generic", "ts": "node_generic", "rs": "rust_generic", "php": "php_generic"}
SERVICE_RULES = (("java_helidon_mp", ("helidon-mp", "helidon.mp")), ("java_helidon_se", ("helidon",)))
#: Own wording: what helps against a finding type, and how it is written in a framework.
ADVICE = {
    "n_plus_one_sql": "load the related rows together with their parents", "n_plus_one_http": "call a batch endpoint, or run the calls at once", "n_plus_one_messaging": "publish one batch a request",
    "redundant_sql": "keep the first result for the request", "redundant_http": "keep the first answer for the request", "slow_sql": "look at the plan, an index or a smaller result", "pool_saturation": "shorten transactions or bound parallel work",
}
HOW = {
    "java_jpa": "a fetch join or an entity graph", "java_quarkus": "a fetch join in the named query", "java_quarkus_reactive": "fetch within the reactive session", "java_webflux": "one query with an IN list, then group", "csharp_ef_core": "Include, or a split query",
    "python_django": "select_related or prefetch_related", "python_sqlalchemy": "selectinload or joinedload", "ruby_active_record": "includes", "go_gorm": "Preload", "node_prisma": "include in the query", "rust_diesel": "belonging_to with grouped_by",
    "rust_sea_orm": "find_with_related", "php_laravel_eloquent": "with() on the query", "php_doctrine": "a fetch join in DQL",
}
BROKERS = {"kafka": "a producer with linger and batches", "rabbitmq": "publisher confirms in batches", "sqs": "SendMessageBatch", "nats": "asynchronous publishes with one flush"}


def _first(rules, hit) -> Column:
    """The framework of the first rule that has a hit."""
    return F.coalesce(*[F.when(hit(names), F.lit(framework)) for framework, names in rules])


def framework() -> Column:
    """From scopes, then the code namespace, then the file ending, then the service name; null if nothing tells."""
    scopes = F.transform(F.coalesce("instrumentation_scopes", F.array().cast("array<string>")), F.lower)
    by_scope = _first(SCOPE_RULES, lambda names: F.exists(scopes, lambda s: F.coalesce(*[F.when(s.contains(n), True) for n in names], F.lit(False))))
    namespace = F.col("code_location.namespace")
    inside = lambda names: F.coalesce(*[F.when(namespace.contains(n), True) for n in names], F.lit(False))
    last = F.element_at(F.split(namespace, r"[.\\:]+"), -1)
    repository = F.when(last.rlike("(Repository|Repo|Dao)$"), F.lit("java_jpa"))
    endings = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    by_file = endings[F.regexp_extract("code_location.filepath", r"\.(\w+)$", 1)]
    by_service = _first(SERVICE_RULES, lambda names: F.coalesce(*[F.when(F.lower("service").contains(n), True) for n in names], F.lit(False)))
    return F.coalesce(by_scope, _first(NAMESPACE_RULES, inside), repository, by_file, by_service)


def enrich_suggestions(findings: DataFrame) -> DataFrame:
    """findings with suggested_fix (pattern, framework, recommendation, reference_url), null where neither is known.

    Publishes are looked up by the broker, the first word of their template.
    """
    advice = F.create_map(*[F.lit(x) for kv in ADVICE.items() for x in kv])[F.col("type")]
    broker = F.lower(F.regexp_extract("pattern.template", r"^(\S+)", 1))
    name = F.when(F.col("type").endswith("_messaging"), F.when(broker.isin(*BROKERS), broker)).otherwise(framework())
    how = F.create_map(*[F.lit(x) for kv in (HOW | BROKERS).items() for x in kv])[name]
    fix = F.struct(F.col("type").alias("pattern"), name.alias("framework"), F.concat_ws(": ", advice, how).alias("recommendation"), F.lit(None).cast("string").alias("reference_url"))
    return findings.withColumn("suggested_fix", F.when(advice.isNotNull() & name.isNotNull(), fix))
