"""Where flows come from and go to."""

from tideflow.sources.connectors import *  # noqa: F403
from tideflow.sources.files import *  # noqa: F403
from tideflow.sources.memory import *  # noqa: F403
from tideflow.sources.pluggable import *  # noqa: F403
