import sys

from speechloom.plans.pipelines import main

sys.exit(main())
