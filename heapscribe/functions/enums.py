"""Fixed values of the trace format: names by code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, in the order of their codes.
USAGES = ("Unknown", "Unbound", "Heap", "Buffer", "Acceleration structure", "Texture", "Render target", "Depth stencil texture", "Internal", "Command buffer", "Descriptors", "Shader pipeline", "Event")
HEAPS = {-1: "Unknown", 0: "Local", 1: "Invisible", 2: "Host", 3: "Unspecified"}
PAGE_SIZES = {1: 4096, 2: 65536, 3: 262144, 4: 1048576, 5: 2097152}
PAGE_SIZE_NAMES = ("UNMAPPED", "4KB", "64KB", "256KB", "1MB", "2MB")
COMMITS = ("COMMITTED", "PLACED", "VIRTUAL")
OWNERS = ("Application", "PAL", "ClientDriver", "KMD")
MISC = ("SUBMIT_GFX", "SUBMIT_COMPUTE", "SUBMIT_COPY", "PRESENT", "INVALIDATE_RANGES", "FLUSH_MAPPED_RAGE", "TRIM_MEMORY")
TABLE_UPDATES = ("DISCARD", "UPDATE", "TRANSFER", "RESERVED")
RESOURCE_TYPES = ("Image", "Buffer", "GPU event", "Border color palette", "Indirect command generator", "Motion estimator", "Performance experiment", "Query heap", "Video decoder", "Video encoder", "Timestamp", "Heap", "Pipeline", "Descriptor heap", "Descriptor pool", "Command allocator", "Misc internal", "Work graph")
TOKENS = ("Timestamp", "Resource update", "Reserved", "Page table update", "User data", "Misc", "Resource reference", "Resource bind", "Process event", "Page reference", "CPU map", "Virtual free", "Virtual allocate", "Resource create", "Time delta", "Resource destroy")
BUFFER_USAGE = ("TRANSFER_SOURCE", "TRANSFER_DESTINATION", "UNIFORM_TEXEL_BUFFER", "STORAGE_TEXEL_BUFFER", "UNIFORM_BUFFER", "STORAGE_BUFFER", "INDEX_BUFFER", "VERTEX_BUFFER", "INDIRECT_BUFFER", "TRANSFORM_FEEDBACK_BUFFER", "TRANSFORM_FEEDBACK_COUNTER_BUFFER", "CONDITIONAL_RENDERING", "RAY_TRACING", "SHADER_DEVICE_ADDRESS")
IMAGE_CREATION = ("INVARIANT", "CLONEABLE", "SHAREABLE", "FLIPPABLE", "STEREO", "CUBEMAP", "PRT", "RESERVED_0", "READ_SWIZZLE_EQUATIONS", "PER_SUBRESOURCE_INIT", "SEPARATE_DEPTH_ASPECT_RATIO", "COPY_FORMATS_MATCH", "REPETITIVE_RESOLVE", "PREFER_SWIZZLE_EQUATIONS", "FIXED_TILE_SWIZZLE", "VIDEO_REFERENCE_ONLY", "OPTIMAL_SHAREABLE", "SAMPLE_LOCATIONS_KNOWN", "FULL_RESOLVE_DEST_ONLY", "EXTERNAL_SHARED")
IMAGE_USAGE = ("SHADER_READ", "SHADER_WRITE", "RESOLVE_SOURCE", "RESOLVE_DESTINATION", "COLOR_TARGET", "DEPTH_STENCIL", "NO_STENCIL_SHADER_READ", "HI_Z_NEVER_INVALID", "DEPTH_AS_Z24", "FIRST_SHADER_WRITABLE_MIP", "CORNER_SAMPLING", "VRS_DEPTH")
BUFFER_CREATION = ("SPARSE_BINDING", "SPARSE_RESIDENCY", "SPARSE_ALIASING", "PROTECTED", "DEVICE_ADDRESS_CAPTURE_REPLAY")
GPU_EVENT = ("GPU_ONLY",)
PIPELINE_CREATION = ("CLIENT_INTERNAL", "OVERRIDE_GPU_HEAP", "RESERVED_0", "RESERVED_1", "RESERVED_2", "RESERVED_3", "RESERVED_4", "RESERVED_5")
COMMAND_ALLOCATOR = ("AUTO_MEMORY_REUSE", "DISABLE_BUSY_CHUNK_TRACKING", "THREAD_SAFE")
PIPELINE_STAGES = ("PS", "HS", "DS", "VS", "GS", "CS", "TS", "MS")
SWIZZLES = ("0", "1", "X", "Y", "Z", "W")
IMAGE_TYPES = ("1D", "2D", "3D")
TILINGS = ("Linear", "Optimal", "Standard Swizzle")
TILING_MODES = ("Balanced", "Space", "Speed")
FORMATS = (
    "UNDEFINED", "X1_UNORM", "X1_USCALED", "X4Y4_UNORM", "X4Y4_USCALED", "L4A4_UNORM", "X4Y4Z4W4_UNORM", "X4Y4Z4W4_USCALED", "X5Y6Z5_UNORM", "X5Y6Z5_USCALED",
    "X5Y5Z5W1_UNORM", "X5Y5Z5W1_USCALED", "X1Y5Z5W5_UNORM", "X1Y5Z5W5_USCALED", "X8_UNORM", "X8_SNORM", "X8_USCALED", "X8_SSCALED", "X8_UINT", "X8_SINT", "X8_SRGB",
    "A8_UNORM", "L8_UNORM", "P8_UNORM", "X8Y8_UNORM", "X8Y8_SNORM", "X8Y8_USCALED", "X8Y8_SSCALED", "X8Y8_UINT", "X8Y8_SINT", "X8Y8_SRGB", "L8A8_UNORM",
    "X8Y8Z8W8_UNORM", "X8Y8Z8W8_SNORM", "X8Y8Z8W8_USCALED", "X8Y8Z8W8_SSCALED", "X8Y8Z8W8_UINT", "X8Y8Z8W8_SINT", "X8Y8Z8W8_SRGB", "U8V8_SNORM_L8W8_UNORM",
    "X10Y11Z11_FLOAT", "X11Y11Z10_FLOAT", "X10Y10Z10W2_UNORM", "X10Y10Z10W2_SNORM", "X10Y10Z10W2_USCALED", "X10Y10Z10W2_SSCALED", "X10Y10Z10W2_UINT", "X10Y10Z10W2_SINT",
    "X10Y10Z10W2BIAS_UNORM", "U10V10W10_SNORM_A2_UNORM", "X16_UNORM", "X16_SNORM", "X16_USCALED", "X16_SSCALED", "X16_UINT", "X16_SINT", "X16_FLOAT", "L16_UNORM",
    "X16Y16_UNORM", "X16Y16_SNORM", "X16Y16_USCALED", "X16Y16_SSCALED", "X16Y16_UINT", "X16Y16_SINT", "X16Y16_FLOAT", "X16Y16Z16W16_UNORM", "X16Y16Z16W16_SNORM",
    "X16Y16Z16W16_USCALED", "X16Y16Z16W16_SSCALED", "X16Y16Z16W16_UINT", "X16Y16Z16W16_SINT", "X16Y16Z16W16_FLOAT", "X32_UINT", "X32_SINT", "X32_FLOAT", "X32Y32_UINT",
    "X32Y32_SINT", "X32Y32_FLOAT", "X32Y32Z32_UINT", "X32Y32Z32_SINT", "X32Y32Z32_FLOAT", "X32Y32Z32W32_UINT", "X32Y32Z32W32_SINT", "X32Y32Z32W32_FLOAT",
    "D16_UNORM_S8_UINT", "D32_FLOAT_S8_UINT", "X9Y9Z9E5_FLOAT", "BC1_UNORM", "BC1_SRGB", "BC2_UNORM", "BC2_SRGB", "BC3_UNORM", "BC3_SRGB", "BC4_UNORM", "BC4_SNORM",
    "BC5_UNORM", "BC5_SNORM", "BC6_UFLOAT", "BC6_SFLOAT", "BC7_UNORM", "BC7_SRGB", "ETC2X8Y8Z8_UNORM", "ETC2X8Y8Z8_SRGB", "ETC2X8Y8Z8W1_UNORM", "ETC2X8Y8Z8W1_SRGB",
    "ETC2X8Y8Z8W8_UNORM", "ETC2X8Y8Z8W8_SRGB", "ETC2X11_UNORM", "ETC2X11_SNORM", "ETC2X11Y11_UNORM", "ETC2X11Y11_SNORM", "ASTCLDR4X4_UNORM", "ASTCLDR4X4_SRGB",
    "ASTCLDR5X4_UNORM", "ASTCLDR5X4_SRGB", "ASTCLDR5X5_UNORM", "ASTCLDR5X5_SRGB", "ASTCLDR6X5_UNORM", "ASTCLDR6X5_SRGB", "ASTCLDR6X6_UNORM", "ASTCLDR6X6_SRGB",
    "ASTCLDR8X5_UNORM", "ASTCLDR8X5_SRGB", "ASTCLDR8X6_UNORM", "ASTCLDR8X6_SRGB", "ASTCLDR8X8_UNORM", "ASTCLDR8X8_SRGB", "ASTCLDR10X5_UNORM", "ASTCLDR10X5_SRGB",
    "ASTCLDR10X6_UNORM", "ASTCLDR10X6_SRGB", "ASTCLDR10X8_UNORM", "ASTCLDR10X8_SRGB", "ASTCLDR10X10_UNORM", "ASTCLDR10X10_SRGB", "ASTCLDR12X10_UNORM",
    "ASTCLDR12X10_SRGB", "ASTCLDR12X12_UNORM", "ASTCLDR12X12_SRGB", "ASTCHDR4x4_FLOAT", "ASTCHDR5x4_FLOAT", "ASTCHDR5x5_FLOAT", "ASTCHDR6x5_FLOAT", "ASTCHDR6x6_FLOAT",
    "ASTCHDR8x5_FLOAT", "ASTCHDR8x6_FLOAT", "ASTCHDR8x8_FLOAT", "ASTCHDR10x5_FLOAT", "ASTCHDR10x6_FLOAT", "ASTCHDR10x8_FLOAT", "ASTCHDR10x10_FLOAT",
    "ASTCHDR12x10_FLOAT", "ASTCHDR12x12_FLOAT", "X8Y8_Z8Y8_UNORM", "X8Y8_Z8Y8_USCALED", "Y8X8_Y8Z8_UNORM", "Y8X8_Y8Z8_USCALED", "AYUV", "UYVY", "VYUY", "YUY2", "YVY2",
    "YV12", "NV11", "NV12", "NV21", "P016", "P010", "P210", "X8 MM UNORM", "X8 MM UINT", "X8Y8 MM UNORM", "X8Y8 MM UINT", "X16 MM10 UNORM", "X16 MM10 UINT",
    "X16Y16 MM10 UNORM", "X16Y16 MM10 UINT", "P208", "X16 MM12 UNORM", "X16 MM12 UINT", "X16Y16 MM12 UNORM", "X16Y16 MM12 UINT", "P012", "P212", "P412",
    "X10Y10Z10W2 FLOAT", "Y216", "Y210", "Y416", "Y410",
)
#: Event of a history: (class, shape).
EVENTS = {
    "create": ("resource", "circle"), "bind": ("resource", "triangle"), "name": ("resource", "triangle"), "destroy": ("resource", "cross"),
    "allocate": ("memory", "triangle"), "free": ("memory", "square"), "cpu map": ("memory", "circle"), "cpu unmap": ("memory", "cross"),
    "resident": ("residency", "circle"), "evict": ("residency", "cross"),
    "map local": ("page table", "circle"), "map host": ("page table", "circle"), "unmap": ("page table", "cross"), "paged": ("page table", "square"),
    "snapshot": ("snapshot", "inverted triangle"),
}
MEMORY_TYPES = ("Unknown", "DDR2", "DDR3", "DDR4", "DDR5", "GDDR5", "GDDR6", "HBM", "HBM2", "HBM3", "LPDDR4", "LPDDR5")
PROCESS_EVENTS = ("START", "STOP")
HEAP, UNBOUND = 2, 1


def named(code: Column, names, default: str = "Unknown") -> Column:
    """Name of a code: a CASE of literals, so it stays in generated code."""
    pairs = names.items() if isinstance(names, dict) else enumerate(names)
    out = None
    for k, v in pairs:
        out = F.when(code == k, v) if out is None else out.when(code == k, v)
    return out.otherwise(default)
