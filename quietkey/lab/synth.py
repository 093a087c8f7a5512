"""Synthetic labelled candidates: one generator, seven specifications.

Every value is a pure function of (seed, index, label, draw), by MD5 of a counter, so the same
seed gives the same rows on any partitioning, and rows are built in parallel without shared
state. Values are built as SQL text, so that any engine with the few functions of a ``Dialect``
makes the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietkey.functions.features import (
    HASH_METADATA_FLAG,
    context_flags,
    looks_like_safe_hash_metadata,
    numeric_features,
)

LOWER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
UPPER = LOWER.upper()
ALNUM = LOWER + UPPER + DIGITS

SENSITIVE = (
    "account_password", "vault_secret", "partner_api_key", "refresh_token",
    "login_credential", "client_secret_value",
)
NEUTRAL = ("content", "item_data", "field_value", "buffer", "entry", "blob", "option", "state")
SECRET_IDENTIFIERS = ("login_session_id", "vault_reference", "auth_request_id", "key_ref")
WORDS = (
    "acorn", "basil", "cedar", "delta", "ember", "fjord", "grove", "heron", "ivory", "jasper",
    "koala", "linen", "maple", "nylon", "otter", "pearl", "quartz",
)


@dataclass(frozen=True)
class Dialect:
    """Where SQL dialects differ: a number from hex digits, and a text of characters made one by one."""

    number: str
    spelled: str


SPARK = Dialect("CAST(conv({0}, 16, 10) AS BIGINT)", "array_join(transform(sequence(1, {0}), i -> {1}), '')")


def literal(text: str) -> str:
    """Text in quotes; Spark would take ``${`` within one literal for a setting."""
    quoted = "'" + text.replace("'", "''").replace("${", "$' || '{") + "'"
    return f"({quoted})" if "${" in text else quoted


def choose(place: str, options: tuple[str, ...]) -> str:
    """The option at ``place``, from 0 on."""
    return f"split_part({literal('|'.join(options))}, '|', CAST({place} + 1 AS INT))"


@dataclass(frozen=True)
class Draw:
    """Seeded pseudo-random choices for the row at ``index``, as SQL."""

    seed: int
    salt: str
    dialect: Dialect = SPARK

    def hash(self, k: int | str, then: str = "") -> str:
        """MD5 in hex of the row and what is drawn; ``then`` is more SQL text to hash."""
        return f"md5('{self.seed}|{self.salt}|{k}|' || index{f' || {then}' if then else ''})"

    def below(self, k: int | str, n: int) -> str:
        return f"({self.dialect.number.format(f'substr({self.hash(k)}, 1, 8)')} % {n})"

    def pick(self, k: int | str, options: tuple[str, ...]) -> str:
        return choose(self.below(k, len(options)), options)

    def hex(self, k: int | str, length: int) -> str:
        blocks = " || ".join(self.hash(f"{k}/{i}") for i in range(-(-length // 32)))
        return f"substr({blocks}, 1, {length})"

    def text(self, k: int | str, alphabet: str, length: int) -> str:
        digits = f"substr({self.hash(f'{k}/', 'i')}, 1, 6)"
        letter = f"substr({literal(alphabet)}, CAST({self.dialect.number.format(digits)} % {len(alphabet)} + 1 AS INT), 1)"
        return self.dialect.spelled.format(length, letter)

    def uuid(self, k: int | str) -> str:
        h = self.hash(k)
        return " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))

    def base64(self, k: int | str, size: int) -> str:
        return f"base64(unhex({self.hex(k, 2 * size)}))"

    def base64url(self, k: int | str, size: int) -> str:
        return f"replace(translate({self.base64(k, size)}, '+/', '-_'), '=', '')"

    def jwt(self, k: int | str) -> str:
        return " || '.' || ".join(self.base64url(f"{k}.{i}", n) for i, n in enumerate((12, 20, 18)))

    def phrase(self, k: int | str, separators: tuple[str, ...] = ("-", ".", " ")) -> str:
        """Four or five words at any index; the last one spells the index, so none repeats."""
        drawn = [self.pick(f"{k}/{i}", WORDS) for i in range(4)]
        spelled = "'um' || translate(lower(hex(index)), '0123456789abcdef', 'bcdfghjklmnprstv')"
        joined = []
        for separator in separators:
            s = literal(separator)
            more = f"CASE WHEN {self.below(f'{k}/words', 2)} = 1 THEN {s} || {drawn[3]} ELSE '' END"
            joined.append(f"{f' || {s} || '.join(drawn[:3])} || {more} || {s} || {spelled}")
        roll = self.below(k, len(separators))
        return cases([(f"{roll} = {i}", j) for i, j in enumerate(joined[:-1])], joined[-1])

    def tag(self) -> str:
        """Short lower-case tag that is unique per index."""
        return f"({self.text('tag', LOWER, 4)} || lower(hex(index)))"


def cases(branches: list[tuple[str, str]], otherwise: str) -> str:
    if not branches:
        return f"({otherwise})"
    return f"CASE {' '.join(f'WHEN {c} THEN {v}' for c, v in branches)} ELSE {otherwise} END"


Make = Callable[[Draw], str]


@dataclass(frozen=True)
class Family:
    """One sample type: how it names and fills a candidate."""

    sample_type: str
    name: Make
    value: Make


@dataclass(frozen=True)
class Spec:
    """A labelled dataset: sample types per label cycle by index."""

    source: str
    prefix: str
    per_class: int
    seed: int
    positive: tuple[Family, ...]
    negative: tuple[Family, ...]
    hard: tuple[Family, ...] = ()
    #: Of so many safe rows, so many are hard.
    hard_share: tuple[int, int] = (0, 1)
    framework: bool = True
    context: bool = False
    hash_metadata: bool = False


def one_of(*options: str) -> Make:
    return lambda d: d.pick("name", options)


def mixed_name(identifier: int, sensitive: int) -> Make:
    """Identifier-like, sensitive and neutral names in percent shares."""

    def make(d: Draw) -> str:
        roll = d.below("roll", 100)
        shares = [(identifier, SECRET_IDENTIFIERS), (identifier + sensitive, SENSITIVE)]
        return cases([(f"{roll} < {n}", d.pick("name", names)) for n, names in shares], d.pick("name", NEUTRAL))

    return make


def alternating(names: tuple[str, ...], plain: tuple[str, ...]) -> Make:
    """Sensitive and neutral names by turns."""
    return lambda d: cases([(f"{d.below('roll', 2)} = 0", d.pick("name", names))], d.pick("name", plain))


def values(*options: str) -> Make:
    return lambda d: d.pick("value", options)


def tagged(*patterns: str) -> Make:
    """Templates around the row's tag: ``{}`` lower case, ``{^}`` upper case."""

    def make(d: Draw) -> str:
        chosen = d.pick("value", patterns)
        return f"replace(replace({chosen}, '{{^}}', upper({d.tag()})), '{{}}', {d.tag()})"

    return make


def lengths(*options: int, make: Callable[[Draw, int], str]) -> Make:
    """One of several lengths."""

    def build(d: Draw) -> str:
        roll = d.below("length", len(options))
        return cases([(f"{roll} = {i}", make(d, n)) for i, n in enumerate(options[:-1])], make(d, options[-1]))

    return build


def text_of(alphabet: str, *options: int) -> Make:
    return lengths(*options, make=lambda d, n: d.text("value", alphabet, n))


def hex_of(*options: int) -> Make:
    return lengths(*options, make=lambda d, n: d.hex("value", n))


def base64_of(*options: int) -> Make:
    return lengths(*options, make=lambda d, n: d.base64("value", n))


def prefixed(prefix: str, make: Make, end: str = "") -> Make:
    return lambda d: f"({literal(prefix)} || {make(d)} || {literal(end)})"


def groups(alphabet: str, count: int, size: int, separator: str) -> Make:
    return lambda d: f" || {literal(separator)} || ".join(d.text(f"value/{i}", alphabet, size) for i in range(count))


def uuid(d: Draw) -> str:
    return d.uuid("value")


def jwt(d: Draw) -> str:
    return d.jwt("value")


def secret_phrase(d: Draw) -> str:
    return d.phrase("value")


def safe_phrase(d: Draw) -> str:
    return f"('default ' || {d.phrase('value', (' ',))})"


def database_url(d: Draw) -> str:
    return f"('postgresql://crane:' || {d.text('value', ALNUM, 18)} || '@ledger.internal/harbor')"


_PUBLIC = one_of("VITE_MAP_STYLE", "NEXT_PUBLIC_HELP_PAGE", "VITE_CARD_LAYOUT", "NEXT_PUBLIC_FONT_SET")
_CLIENT = one_of("VITE_LEDGER_SECRET", "NEXT_PUBLIC_ADMIN_PASSWORD", "VITE_MAILER_ACCESS_KEY")
_SAFE_IDS = one_of("parcel_id", "batch_uuid", "visit_ref", "device_identifier")
_REFERENCES = tagged(
    "${LEDGER_{^}_PASS}", "process.env.HARBOR_{^}", "$env:DOCK_{^}", "%CRANE_{^}%",
    "vault://harbor/{}/pier",
)
_PLACEHOLDERS = tagged(
    "put-example-{}-here", "placeholder.{}", "DEMO_{^}_ONLY", "[redacted {}]", "fake-{}-value",
)
_SETTINGS = tagged("layout-{}", "zone-{}", "rollout-{}")
_URLS = values(
    "https://handbook.harbor.test/start", "http://127.0.0.1:9100/ping", "https://status.harbor.test/"
)
_LABELS = values(
    "Type the passphrase for this vault", "Your token could not be read", "Choose a stronger password"
)
_CONFIG = values("blue", "canary", "north-2", "verbose", "CET")
_half = alternating(SENSITIVE, NEUTRAL)


# The sample types of all specifications below.
def _classic_positive(name: Make) -> tuple[Family, ...]:
    return (
        Family("password", name, text_of(ALNUM + "!@#$%", 15, 21)),
        Family("api_key", name, prefixed("hk-", text_of(ALNUM, 26, 30))),
        Family("access_token", name, text_of(ALNUM + "_-", 35, 41)),
        Family("database_credential", name, database_url),
        Family("client_exposed_secret", _CLIENT, text_of(ALNUM + "_-", 38)),
    )


V1 = Spec(
    "synthetic", "V1", 500, 42,
    positive=_classic_positive(mixed_name(0, 65)),
    negative=(
        Family("placeholder", one_of(*SENSITIVE), values("your-value-goes-here", "insert_later", "not_configured")),
        Family("ui_text", one_of("banner"), _LABELS),
        Family("uuid", _SAFE_IDS, uuid),
        Family("url", one_of("help_url"), _URLS),
        Family("color", one_of("frame_color"), values("#0B7A75", "#C8D5B9", "#2D2A32")),
        Family("public_identifier", one_of("listing_id"), prefixed("OPEN-", text_of(ALNUM, 12))),
        Family("filename", one_of("profile_file"), values("harbor.toml", "routes.ini")),
        Family("normal_config", one_of("zone", "verbosity"), _CONFIG),
        Family("frontend_public_value", _PUBLIC, values("Lighthouse", "Mooring")),
    ),
)

V2 = Spec(
    "synthetic_v2", "V2", 500, 42,
    positive=_classic_positive(_half),
    hard=(
        Family("placeholder", one_of(*SENSITIVE), values("your-value-goes-here", "insert_later")),
        Family("environment_reference", one_of(*SENSITIVE), values("${HARBOR_PASS}", "$env:HARBOR_PIN")),
        Family("redacted", one_of(*SENSITIVE), values("[redacted]", "xxxxxxxx")),
        Family("sensitive_ui_text", one_of(*SENSITIVE), _LABELS),
    ),
    hard_share=(2, 5),
    negative=(
        Family("ui_text", one_of("banner"), _LABELS),
        Family("uuid", _SAFE_IDS, uuid),
        Family("sha256", one_of("bundle_hash"), hex_of(64)),
        Family("checksum", one_of("checksum"), hex_of(40)),
        Family("public_identifier", one_of("listing_id"), prefixed("OPEN-", text_of(ALNUM, 20))),
        Family("build_id", one_of("bundle_id"), text_of(ALNUM, 28)),
        Family("url", one_of("help_url"), _URLS),
        Family("normal_config", one_of("zone", "verbosity"), _CONFIG),
        Family("frontend_public_value", _PUBLIC, values("Lighthouse", "Mooring")),
    ),
)

_V3_NAME = mixed_name(20, 30)
V3 = Spec(
    "synthetic_v3", "V3", 1000, 1337, context=True,
    positive=(
        Family("random_secret", _V3_NAME, text_of(ALNUM + "_-!@#$%", 32)),
        Family("passphrase_secret", _V3_NAME, secret_phrase),
        Family("jwt_like_secret", _V3_NAME, jwt),
        Family("hex_secret", _V3_NAME, hex_of(32, 40, 48, 64)),
        Family("uuid_shaped_secret", _V3_NAME, uuid),
        Family("hash_shaped_secret", _V3_NAME, hex_of(40, 64)),
        Family("client_exposed_secret", _CLIENT, text_of(ALNUM + "_-", 38)),
    ),
    negative=(
        Family("uuid_identifier", _SAFE_IDS, uuid),
        Family("commit_hash", one_of("keel_commit_sha"), hex_of(40)),
        Family("artifact_digest", one_of("image_digest", "checksum"), hex_of(64)),
        Family("public_identifier", one_of("listing_id", "bundle_id"), text_of(UPPER + DIGITS, 26)),
        Family("secret_reference", one_of(*SENSITIVE), _REFERENCES),
        Family("placeholder", one_of(*SENSITIVE), _PLACEHOLDERS),
        Family("documentation_jwt", one_of("jwt_sample", "token_sample"), jwt),
        Family("safe_phrase", one_of("release_notes", "app_setting"), safe_phrase),
        Family("frontend_public_value", _PUBLIC, _SETTINGS),
        Family("normal_config", one_of("environment", "feature_mode"), tagged("dock-{}", "pier-{}")),
    ),
)

CHALLENGE = Spec(
    "challenge_v1", "C1", 200, 2026,
    positive=(
        Family("hex_secret", _half, hex_of(48, 64)),
        Family("jwt_like_secret", _half, jwt),
        Family("base64_secret", _half, base64_of(24, 32)),
        Family("passphrase_secret", _half, secret_phrase),
        Family("opaque_secret", _half, text_of(ALNUM + "_-", 34)),
    ),
    negative=(
        Family("git_commit_hash", one_of("keel_commit_sha"), hex_of(40)),
        Family("artifact_digest", one_of("bundle_digest"), hex_of(64)),
        Family("trace_uuid", one_of("wake_trace_id"), uuid),
        Family("public_reference", one_of("shipper_ref"), prefixed("CARGO-", text_of(UPPER + DIGITS, 24))),
        Family("documentation_placeholder", one_of("crane_key_demo", "crane_token_demo"), _PLACEHOLDERS),
        Family("secret_reference", one_of("dock_token_source", "dock_secret_source"), _REFERENCES),
        Family("public_url", one_of("chart_url"), _URLS),
        Family("frontend_public_config", _PUBLIC, _SETTINGS),
    ),
)

FINAL = Spec(
    "final_challenge_v2", "F2", 300, 8142026,
    positive=(
        Family("prefixed_opaque_secret", _half, prefixed("hx_", text_of(ALNUM, 31))),
        Family("colon_segment_secret", _half, groups(ALNUM, 4, 8, ":")),
        Family("credential_uri_secret", _half, database_url),
        Family("word_chain_secret", _half, secret_phrase),
        Family("base32_secret", _half, text_of(UPPER + "234567", 32)),
        Family("compact_mixed_secret", _half, text_of(ALNUM + "+/", 22)),
    ),
    negative=(
        Family("ulid_identifier", one_of("mooring_ulid"), text_of("0123456789ABCDEFGHJKMNPQRSTVWXYZ", 26)),
        Family("sri_integrity", one_of("sail_integrity"), prefixed("sha384-", base64_of(36))),
        Family("http_etag", one_of("cargo_etag"), prefixed('"', hex_of(32), '"')),
        Family("telemetry_span", one_of("voyage_span"), hex_of(32)),
        Family("deployment_revision", one_of("rollout_revision"), prefixed("roll-", hex_of(16))),
        Family("public_webhook_id", one_of("pier_hook_id"), prefixed("wh-", text_of(ALNUM, 27))),
        Family("config_template_reference", one_of("berth_token_form", "berth_secret_form"), tagged("{{ harbor.{} }}")),
        Family("documentation_literal", one_of("anchor_secret_demo", "anchor_token_demo"), tagged("SAMPLE_{^}_TEXT")),
        Family("astro_public_config", one_of("PUBLIC_SITE_THEME", "PUBLIC_DOCS_HOST"), tagged("public-{}")),
        Family("certificate_fingerprint", one_of("hull_fingerprint"), groups("0123456789ABCDEF", 20, 2, ":")),
    ),
)

_DEV_NAME = mixed_name(12, 45)
DEV = Spec(
    "candidate_v2_dev_v1", "DEV", 300, 260815, framework=False, context=True,
    positive=(
        Family("alternate_random_secret", _DEV_NAME, text_of(ALNUM + "_-!@", 29, 36)),
        Family("alternate_passphrase_secret", _DEV_NAME, secret_phrase),
        Family("alternate_jwt_secret", _DEV_NAME, jwt),
        Family("alternate_hex_secret", _DEV_NAME, hex_of(40, 64)),
        Family("alternate_uuid_secret", _DEV_NAME, uuid),
        Family("alternate_base64_secret", _DEV_NAME, base64_of(24, 30)),
        Family("alternate_client_exposed_secret", _CLIENT, text_of(ALNUM + "_-", 34)),
    ),
    negative=(
        Family("alternate_uuid_identifier", _SAFE_IDS, uuid),
        Family("alternate_source_hash", one_of("ledger_revision", "quay_repository_sha"), hex_of(40)),
        Family("alternate_checksum", one_of("crate_checksum", "bale_digest"), hex_of(64)),
        Family("alternate_secret_reference", one_of(*SENSITIVE), _REFERENCES),
        Family("alternate_placeholder", one_of(*SENSITIVE), _PLACEHOLDERS),
        Family("alternate_documentation_jwt", one_of("bearer_demo", "jwt_primer"), jwt),
        Family("alternate_safe_phrase", one_of("harbour_policy", "tide_notes"), safe_phrase),
        Family("alternate_public_identifier", one_of("berth_ref", "lift_id"), text_of(UPPER + DIGITS, 24)),
        Family("alternate_frontend_public_config", _PUBLIC, _SETTINGS),
    ),
)

_HOLD_NAME = mixed_name(22, 33)
HOLDOUT = Spec(
    "candidate_v2_holdout_v1", "HOLD", 400, 8152601, framework=False, context=True,
    hash_metadata=True,
    positive=(
        Family("holdout_rotating_access_secret", _HOLD_NAME, text_of(ALNUM + "_-!$%@", 29, 34, 42)),
        Family("holdout_bearer_triplet_secret", _HOLD_NAME, jwt),
        Family("holdout_standard_base64_secret", _HOLD_NAME, base64_of(22, 26, 33)),
        Family("holdout_uuid_credential_secret", _HOLD_NAME, uuid),
        Family("holdout_segmented_secret", _HOLD_NAME, groups(ALNUM, 5, 6, "-")),
        Family("holdout_client_runtime_secret", _CLIENT, text_of(ALNUM + "_-", 32, 38, 43)),
        Family("holdout_hex_material_secret", _HOLD_NAME, hex_of(40, 64)),
        Family("holdout_misleading_hash_secret", one_of("manifest_fingerprint", "winch_checksum"), hex_of(40, 64)),
        Family("holdout_phrase_credential_secret", _HOLD_NAME, secret_phrase),
    ),
    negative=(
        Family("holdout_release_commit_hash", one_of("launch_commit", "yard_revision"), hex_of(40)),
        Family("holdout_module_checksum_hash", one_of("winch_checksum", "pallet_digest"), hex_of(64)),
        Family("holdout_documentation_bearer", one_of("bearer_primer", "access_demo"), jwt),
        Family("holdout_secret_store_reference", one_of(*SENSITIVE), _REFERENCES),
        Family("holdout_redacted_configuration", one_of(*SENSITIVE), _PLACEHOLDERS),
        Family("holdout_frontend_public_setting", _PUBLIC, _SETTINGS),
        Family("holdout_object_uuid_identifier", _SAFE_IDS, uuid),
        Family("holdout_public_segmented_identifier", one_of("permit_id", "freight_ref"), groups(ALNUM, 5, 6, "-")),
        Family("holdout_safe_configuration_phrase", one_of("launch_notes", "harbour_text"), safe_phrase),
        Family("holdout_public_base64_blob", one_of("flag_blob", "emblem_blob"), base64_of(22, 26, 33)),
    ),
)

SPECS = {
    "v1": V1, "v2": V2, "v3": V3, "challenge": CHALLENGE, "final": FINAL, "dev": DEV,
    "holdout": HOLDOUT,
}


def _build(families: tuple[Family, ...], turn: str, draw: Draw, field: str) -> str:
    """Name, value or type of the family whose turn it is."""
    made = [
        f"CAST({literal(f.sample_type)} AS STRING)" if field == "sample_type" else (f.name if field == "variable_name" else f.value)(draw)
        for f in families
    ]
    return cases([(f"{turn} % {len(families)} = {i}", x) for i, x in enumerate(made[:-1])], made[-1])


def sample_sql(spec: Spec, label: int, field: str, seed: int | None = None, dialect: Dialect = SPARK) -> str:
    """``variable_name``, ``value`` or ``sample_type`` of the row at ``index``, as SQL.

    Of the first n safe rows, n times the hard share (rounded down) are hard, for every n.
    """
    draw = Draw(spec.seed if seed is None else seed, f"{spec.source}/{label}", dialect)
    if label:
        return _build(spec.positive, "index", draw, field)
    if not spec.hard:
        return _build(spec.negative, "index", draw, field)
    some, all_ = spec.hard_share

    def hard_before(index: str) -> str:
        return f"CAST((({index}) * {some} - (({index}) * {some}) % {all_}) / {all_} AS BIGINT)"

    eased = _build(spec.negative, f"(index - {hard_before('index')})", draw, field)
    hard = _build(spec.hard, hard_before("index"), draw, field)
    return cases([(f"{hard_before('index + 1')} > {hard_before('index')}", hard)], eased)


def synth_candidates(indexes: DataFrame, spec: Spec, seed: int | None = None) -> DataFrame:
    """Balanced labelled candidates: one secret and one safe row per bigint ``index`` from 0 on."""
    fields = ("variable_name", "value", "sample_type")
    sides = F.array(
        *(F.struct(F.lit(label).alias("label"), *(F.expr(sample_sql(spec, label, f, seed)).alias(f) for f in fields)) for label in (1, 0))
    )
    rows = indexes.select("index", F.explode(sides).alias("side")).select(
        F.format_string(
            f"{spec.prefix}-%06d", F.col("index") * 2 + F.lit(2) - F.col("side.label")
        ).alias("sample_id"),
        "side.variable_name",
        "side.value",
        "side.label",
        "side.sample_type",
        F.lit(spec.source).alias("source"),
    )
    name, value = F.col("variable_name"), F.col("value")
    extra = []
    if spec.framework:
        extra.append(
            F.when(F.startswith(name, F.lit("VITE_")), F.lit("Vite"))
            .when(F.startswith(name, F.lit("NEXT_PUBLIC_")), F.lit("Next.js"))
            .when(F.startswith(name, F.lit("PUBLIC_")), F.lit("Astro"))
            .otherwise(F.lit("none"))
            .alias("framework")
        )
    features = numeric_features(name, value)
    if spec.context:
        features += context_flags(name, value)
    if spec.hash_metadata:
        features.append(looks_like_safe_hash_metadata(name, value).alias(HASH_METADATA_FLAG))
    return rows.select(*rows.columns, *extra, *features)


def generate(spark: SparkSession, spec: Spec, samples: int | None = None, seed: int | None = None) -> DataFrame:
    """The dataset of a specification at its default or a chosen size."""
    samples = spec.per_class if samples is None else samples
    if samples <= 0:
        raise ValueError("samples must be greater than zero.")
    indexes = spark.range(samples).select(F.col("id").alias("index"))
    return synth_candidates(indexes, spec, seed)
