"""python -m codeloom"""

import sys

from codeloom.cli import main

sys.exit(main())
