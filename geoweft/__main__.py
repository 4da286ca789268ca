import sys

from geoweft.cli import main

sys.exit(main())
