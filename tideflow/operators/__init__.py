"""Every operator: functions whose first argument is an OrderedFlow; each is a method of it too."""

from tideflow.operators.aggregate import *  # noqa: F403
from tideflow.operators.combine import *  # noqa: F403
from tideflow.operators.compose import *  # noqa: F403
from tideflow.operators.effects import *  # noqa: F403
from tideflow.operators.expand import *  # noqa: F403
from tideflow.operators.fanout import *  # noqa: F403
from tideflow.operators.select import *  # noqa: F403
from tideflow.operators.state import *  # noqa: F403
from tideflow.operators.timeops import *  # noqa: F403
from tideflow.operators.transforms import *  # noqa: F403
from tideflow.operators.window import *  # noqa: F403
