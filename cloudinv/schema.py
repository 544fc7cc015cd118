"""Record layouts: snapshot documents, the inventory table, job documents."""

from pyspark.sql import types as T

# Resource type names as they appear in configuration items.
VPC = "AWS::EC2::VPC"
SUBNET = "AWS::EC2::Subnet"
INSTANCE = "AWS::EC2::Instance"
VOLUME = "AWS::EC2::Volume"
NETWORK_INTERFACE = "AWS::EC2::NetworkInterface"
KEY = "AWS::KMS::Key"
ROLE = "AWS::IAM::Role"
FUNCTION = "AWS::Lambda::Function"
DB_INSTANCE = "AWS::RDS::DBInstance"
BUCKET = "AWS::S3::Bucket"

# The stages a question goes through, in order.
STAGES = ("embed", "retrieve", "generate", "athena")

# The members of a configuration item as delivered. Payload members are JSON of any shape;
# declaring them as strings makes the reader keep their JSON text.
ITEM = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "awsAccountId",
            "ARN",
            "resourceType",
            "resourceId",
            "resourceName",
            "awsRegion",
            "availabilityZone",
            "configurationItemStatus",
            "configurationItemCaptureTime",
            "resourceCreationTime",
            "configurationStateId",
            "configurationStateMd5Hash",
            "tags",
            "relationships",
            "configuration",
            "supplementaryConfiguration",
        )
    ]
)

CORRUPT = "_corrupt"

SNAPSHOT = T.StructType(
    [
        T.StructField("fileVersion", T.StringType()),
        T.StructField("configSnapshotId", T.StringType()),
        T.StructField("configurationItems", T.ArrayType(ITEM)),
        T.StructField(CORRUPT, T.StringType()),
    ]
)

_TIMES = ("captured_at", "created_at", "last_seen_at")

# The columns of the inventory table, in order.
OPERATIONAL_COLUMNS = (
    "account_id",
    "arn",
    "resource_type",
    "resource_id",
    "resource_name",
    "aws_region",
    "availability_zone",
    "status",
    "captured_at",
    "created_at",
    "state_id",
    "state_hash",
    "tags",
    "relationships",
    "configuration",
    "supplementary_configuration",
    "last_seen_at",
    "source_key",
)

OPERATIONAL = T.StructType(
    [
        T.StructField(c, T.TimestampType() if c in _TIMES else T.StringType())
        for c in OPERATIONAL_COLUMNS
    ]
)

#: The configuration parsed once when it was written, and its text where it could not be.
PAYLOAD, PAYLOAD_TEXT = "payload", "payload_text"

RELATIONSHIPS = "array<struct<resourceId:string,resourceType:string,name:string>>"

JOB = (
    "job_id string, status string, stage string, submitted_at string, updated_at string, "
    "question string, top_k int, "
    "stages map<string,struct<status:string,started_at:string,ended_at:string,ms:double>>, "
    "result struct<sql:string,row_count:bigint>, "
    "error struct<error:string,detail:string,stage:string>"
)

ENRICHMENT = (
    "resource_type string, service string, category string, description string, "
    "common_queries array<string>, "
    "notable_fields array<struct<path:string,description:string>>, "
    "relationships_to array<string>"
)
